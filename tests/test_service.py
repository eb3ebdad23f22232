import pytest

from tablehealth.operators import layout
from tablehealth.service import Service
from tablehealth.sources import store as stores


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    spark.sql("CREATE DATABASE IF NOT EXISTS web")
    layout.write_layout(spark.range(90), "web.even", "HASH", ["id"], 4)
    layout.write_layout(spark.range(90).selectExpr("id", "id - id AS k"), "web.bad", "HASH", ["k"], 4)
    made = stores.Store(spark, str(tmp_path_factory.mktemp("web") / "store"))
    made.bootstrap()
    return Service(spark, made)


def test_sources(service, tmp_path):
    assert service.add_source("", "x")[0] == 400
    id_ = service.add_source(" lake ", str(tmp_path / "none"))[1]["id"]
    assert [s["name"] for s in service.sources()[1]["sources"]] == ["lake"]
    assert service.test_source(id_)[1]["ok"] is False and service.test_source(5)[0] == 404
    service.delete_source(id_)
    assert service.sources()[1]["sources"] == []


def test_tree(service):
    tables = {t["full_name"] for s in service.object_tree("web")[1]["schemas"] for t in s["tables"]}
    assert {"web.even", "web.bad"} <= tables


def test_skew_at_once_and_as_a_job(service):
    assert service.analyze([])[0] == 400 and service.start_skew([])[0] == 400
    asked = [{"schema": "web", "table": "even"}, {"schema": "web", "table": "bad"}, {"schema": "web", "table": "gone"}, {"schema": "", "table": "x"}]
    found = {r["table_name"]: r for r in service.analyze(asked)[1]["results"]}
    assert found["even"]["status"] == "OK" and found["bad"]["status"] == "CRITICAL" and len(found["bad"]["segments"]) == 4
    assert found["gone"]["status"] == found["x"]["status"] == "FAILED"
    job = service.start_skew(asked, wait=True)[1]["job_id"]
    state = service.job(job)[1]["job"]
    assert (state["status"], state["done_items"], state["failed_items"]) == ("done", 2, 2)
    assert [i["status"] for i in service.job_items(job)[1]["items"]] == ["done", "done", "failed", "failed"]
    ranked = service.skew_results("x")[1]["results"]
    assert [r["table_name"] for r in ranked] == ["bad", "even"]
    assert [r["table_name"] for r in service.problem_tables()[1]["results"]] == ["bad"]
    assert service.job_results(job)[1]["summary"]["critical"] == 1
    one = service.result_segments(ranked[0]["id"])[1]
    assert sum(s["row_count"] for s in one["segments"]) == 90 and one["result"]["status"] == "CRITICAL"
    assert service.result_segments(1)[0] == 404 and service.job(1)[0] == 404
    assert service.latest_job()[1]["job"]["job_id"] == job and service.latest_job("none")[0] == 404
    assert service.active_jobs()[1]["jobs"] == [] and service.stop_job(job)[0] == 200


def test_layout_calls(service, spark):
    assert service.recommendation("", "x")[0] == 400
    advice = service.recommendation("web", "bad")[1]
    assert advice["ok"] and advice["recommendation_type"] == "RANDOM"  # no statistics, no scan
    assert not service.recommendation("web", "gone")[1]["ok"]
    assert service.apply_distribution("web", "bad", "")[0] == 400
    assert service.apply_distribution("web", "bad", "HASH", ["id"])[1]["status"] == "SUCCESS"
    assert service.analyze([{"schema": "web", "table": "bad"}])[1]["results"][0]["status"] == "OK"
    assert service.start_reorganize([])[0] == 400 and service.start_reorganize([{"schema": "web", "table": "gone"}])[0] == 400
    reply = service.start_reorganize([{"schema": "web", "table": "even"}, {"schema": "web", "table": "even"}], wait=True)[1]
    assert reply["total_items"] == 1 and service.job(reply["job_id"])[1]["job"]["status"] == "done"
