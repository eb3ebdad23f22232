import time

import pytest
from pyspark.sql import functions as F

from tablehealth.operators import jobs, skew
from tablehealth.sources import store as stores
from tablehealth.streaming import progress


@pytest.fixture
def store(spark, tmp_path):
    made = stores.Store(spark, str(tmp_path / "store"))
    made.bootstrap()
    return made


def test_progress_cases(spark):
    rows = [(1, s) for s in ("done", "done", "failed", "interrupted", "skipped", "running")] + [(2, s) for s in ("done", "queued", "running")]
    found = {r.job_id: tuple(r)[1:] for r in jobs.progress(spark.createDataFrame(rows, "job_id long, status string")).collect()}
    assert found == {1: (6, 2, 2, 1, 83.33), 2: (3, 1, 0, 0, 33.33)}


def test_a_job_runs_item_by_item(spark, store):
    log = jobs.JobLog(store)
    job = log.submit("skew", [("s", "good"), ("s", "bad"), ("", "nameless")], {"tables": []})
    results = []

    def work(session, schema, table):
        if table == "bad":
            raise ValueError("no such table")
        results.append(skew.analyze(session.range(10), F.col("id") % 2).first().status)

    assert log.run(job, work) == "done" and results == ["OK"]
    state = log.states().first()
    assert (state.status, state.total_items, state.done_items, state.failed_items, state.progress_percent) == ("done", 3, 1, 2, 100.0)
    items = {r.message: r.status for r in jobs.item_states(log.events(job)).collect()}
    assert items["no such table"] == "failed"
    assert all(r.duration_seconds is None or r.duration_seconds >= 0 for r in jobs.item_states(log.events(job)).collect())
    log.request_stop(job)  # finished: nothing happens
    log.request_stop(12345)
    assert log.states().first().status == "done"


def test_stopping_skips_the_rest(spark, store):
    log = jobs.JobLog(store)
    job = log.submit("reorganize", [("s", "one"), ("s", "two"), ("s", "three")], action="REORGANIZE")

    def work(session, schema, table):
        log.request_stop(job)

    assert log.run(job, work) == "cancelled"
    status = [r.status for r in jobs.item_states(log.events(job)).orderBy("item_id").collect()]
    assert status == ["done", "skipped", "skipped"]
    assert log.states().first().status == "cancelled"
    assert {r.action for r in log.items(job)} == {"REORGANIZE"}


def test_a_job_in_a_thread(spark, store):
    log = jobs.JobLog(store)
    job = log.submit("skew", [("s", "t")])
    log.start(job, lambda session, s, t: session.range(5).count()).join(60)
    assert log.states().first().status == "done"


def test_recovery(spark, store):
    log = jobs.JobLog(store)
    open_, done = log.submit("skew", [("s", "a"), ("s", "b")]), log.submit("skew", [])
    log.record(open_, "running")
    log.record(open_, "done", log.items(open_)[0]["id"])
    log.record(done, "done")
    again = jobs.JobLog(store)
    assert again.recover() == [open_] and again.recover() == []
    states = {r.job_id: (r.status, r.message) for r in jobs.job_states(store.read("job_events")).collect()}
    assert states[open_] == ("interrupted", "Application restarted while job was running") and states[done][0] == "done"
    assert sorted(r.status for r in jobs.item_states(again.events(open_)).collect()) == ["done", "interrupted"]


def test_recovery_of_states(spark):
    df = spark.createDataFrame([(1, "queued", None), (2, "running", "x"), (3, "done", None), (4, "stopping", "")], "id long, status string, message string")
    found = {r.id: (r.status, r.message) for r in jobs.recover(df).collect()}
    default = "Application restarted while job was running"
    assert found == {1: ("interrupted", default), 2: ("interrupted", "x"), 3: ("done", None), 4: ("interrupted", default)}


def test_done_does_not_undo_cancelled(spark):
    events = spark.createDataFrame([(1, None, 1, "running"), (1, None, 2, "cancelled"), (1, None, 3, "done")], "job_id long, item_id long, seq long, event string").withColumn("at", F.current_timestamp()).withColumn("message", F.lit(None).cast("string"))
    assert jobs.job_states(events).first().status == "cancelled"


def test_first_occurrence(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "x"), (2, "a.x", "")], "pos int, s string, t string")
    assert sorted(r.pos for r in jobs.first_occurrence(df, ["s", "t"]).collect()) == [1, 2]


def test_results_round_trip_and_evolve(spark, store):
    header = spark.createDataFrame([(1, "s", "t", 10)], "id long, schema_name string, table_name string, total_rows long")
    segments = spark.createDataFrame([(1, 1, 0, 10)], "id long, skew_result_id long, segment_id int, row_count long")
    stores.save_results(store, header, segments)
    assert store.find("skew_results", 1).first().total_rows == 10 and store.find("skew_results", 9).isEmpty()
    assert store.read("skew_results").first().job_id is None


def test_sources(spark, store, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "data"))
    stores.add_source(store, 1, " lake ", str(tmp_path / "data"))
    with pytest.raises(ValueError):
        stores.add_source(store, 2, " ", "x")
    one = store.find("sources", 1).first()
    assert one.name == "lake" and one.format == "parquet"
    assert stores.open_source(spark, one.format, one.location).count() == 3
    assert stores.probe(spark, "parquet", one.location)["ok"] and not stores.probe(spark, "parquet", "/no/such/place")["ok"]


def test_stream_follows_the_log(spark, store, tmp_path):
    log = jobs.JobLog(store)
    job = log.submit("skew", [("s", "a"), ("s", "b")])
    log.record(job, "done", log.items(job)[0]["id"])
    stream = progress.latest_events(progress.event_stream(store).where("item_id IS NOT NULL"), ["job_id", "item_id"], ["seq"], "event")
    seen = []
    query = progress.follow(stream, lambda df, n: seen.append(sorted(r.status for r in df.collect())), seconds=1, checkpoint=str(tmp_path / "ck"))
    until = time.time() + 60
    while not seen and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert seen[-1] == ["done", "queued"]


def test_a_stop_that_another_process_asked_for(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "shared"))
    store.bootstrap()
    log, other = jobs.JobLog(store), jobs.JobLog(store)
    job, done = log.submit("skew", [("s", "a"), ("s", "b")]), []

    def work(spark, schema, table):
        done.append(table)
        other.record(job, "stopping")

    assert log.run(job, work) == "cancelled" and done == ["a"]
