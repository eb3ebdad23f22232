"""Commits, compaction, leases, guarded states, resumable streams."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tablehealth.operators import hierarchy, jobs, layout, machine, profile
from tablehealth.plans import catalogue, derived
from tablehealth.service import Service
from tablehealth.sources import catalog, files
from tablehealth.sources import store as stores


@pytest.fixture
def store(spark, tmp_path):
    made = stores.Store(spark, str(tmp_path / "store"))
    made.bootstrap()
    return made


def _header(spark, id_, n):
    return spark.createDataFrame([(id_, "s", "t", n)], "id long, schema_name string, table_name string, total_rows long")


def _segments(spark, id_, *counts):
    return spark.createDataFrame([(id_, i, n) for i, n in enumerate(counts)], "skew_result_id long, segment_id int, row_count long")


# commits


def test_a_write_is_visible_whole_or_not_at_all(spark, store, monkeypatch):
    assert store.read("skew_results").isEmpty()
    stores.save_results(store, _header(spark, 1, 10), _segments(spark, 1, 4, 6))
    monkeypatch.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        stores.save_results(store, _header(spark, 2, 5), _segments(spark, 2, 5))
    again = stores.Store(spark, store.path)
    assert [r.id for r in again.read("skew_results").collect()] == [1]
    assert again.read("skew_result_segments").count() == 2
    assert len(again.files.names("skew_results")) == 2  # the lost write's folder is still there
    assert again.vacuum(0) >= 2 and len(again.files.names("skew_results")) == 1
    assert again.read("skew_result_segments").count() == 2


def test_a_name_is_taken_once(spark, tmp_path):
    found = files.Files(spark, str(tmp_path / "x"))
    assert found.create("a/b.json", {"n": "ü"}) and not found.create("a/b.json", {"n": 2})
    assert found.read("a/b.json") == {"n": "ü"} and found.read("a/c.json") is None
    won, start = [], threading.Barrier(6)

    def race(i):
        start.wait()
        if found.create("a/race", {"i": i}):
            won.append(i)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert found.read("a/race")["i"] in won and len(won) >= 1


def test_compaction_keeps_rows_and_bounds_files(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "MOST_RUNS", 2)
    log = jobs.JobLog(store)
    expected = []
    for i in range(15):
        if i % 3:
            log.record(7, "running", i)
        else:
            store.append("job_events", spark.createDataFrame([(7, i, i, "queued")], "job_id long, item_id long, seq long, event string"))
        expected.append(i)
        if i % 3 == 2:
            assert store.compact("job_events")
        if i == 9:
            store.vacuum(0)
    assert sorted(r.item_id for r in stores.Store(spark, store.path).read("job_events").collect()) == expected
    assert not store.compact("job_events")  # nothing new
    store.vacuum(0)
    assert len(store.files.names("job_events")) <= stores.MOST_RUNS + 1
    assert len([n for n in store.files.names("_log") if n.startswith("c-")]) == 0
    assert sorted(r.item_id for r in stores.Store(spark, store.path).read("job_events").collect()) == expected
    assert {r.at is None for r in store.read("job_events").where("event = 'running'").collect()} == {False}


def test_of_two_compactions_one_counts(spark, store, monkeypatch):
    other = stores.Store(spark, store.path)
    log = jobs.JobLog(store)
    log.record(1, "queued")
    real = other.files.create

    def late(name, content):
        assert store.compact("job_events")
        log.record(1, "running")
        return real(name, content)

    monkeypatch.setattr(other.files, "create", late)
    assert other.compact("job_events") is False
    assert sorted(r.event for r in store.read("job_events").collect()) == ["queued", "running"]


def test_rows_of_the_log_start_no_job(spark, store):
    log = jobs.JobLog(store)
    job = log.submit("skew", [("s", "a")])
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    since = log.record(job, "running")
    assert not log.stopping(job, since)
    jobs.JobLog(store).record(job, "stopping")
    assert log.stopping(job, since)
    assert len(tracker.getJobIdsForGroup()) == before
    store.compact("job_events")
    assert log.stopping(job, since)  # asked of the snapshot now


def test_a_reader_meets_a_compaction_between_listing_and_reading(spark, store, monkeypatch):
    log, reader = jobs.JobLog(store), stores.Store(spark, store.path)
    for i in range(3):
        log.record(1, "running", i)
    names = reader.files.names

    def listed(folder=""):
        found = names(folder)
        monkeypatch.setattr(reader.files, "names", names)
        store.compact("job_events")
        store.vacuum(0)
        return found

    monkeypatch.setattr(reader.files, "names", listed)
    assert sorted(r.item_id for r in reader.read("job_events").collect()) == [0, 1, 2]


# leases


def test_leases(spark, tmp_path):
    one, two = files.Leases(spark, str(tmp_path), 1.0), files.Leases(spark, str(tmp_path), 1.0)
    assert one.claim("job") and one.claim("job") and not two.claim("job") and two.claim("other")
    assert one.holder("job") == one.owner
    time.sleep(1.1)
    assert one.holder("job") is None and two.claim("job") and not one.claim("job")
    one.release("job")  # not its own any more
    assert two.holder("job") == two.owner
    two.release("job")
    assert one.claim("job") and len(one.files.names("job")) <= 2
    with one.held("long") as lease:
        time.sleep(1.6)  # longer than a claim lasts: it is renewed meanwhile
        assert not lease.lost and not two.claim("long")
    assert two.claim("long")


def test_a_second_driver_neither_repeats_nor_drops_a_running_job(spark, store):
    log, other = jobs.JobLog(store, 2.0), jobs.JobLog(store, 2.0)
    job, ran, seen = log.submit("skew", [("s", "a"), ("s", "b")]), [], []

    def work(session, schema, table):
        ran.append(table)
        if table == "a":
            seen.append((other.run(job, work), other.recover()))

    assert log.run(job, work) == "done"
    assert ran == ["a", "b"] and seen == [("taken", [])]


def test_a_job_goes_on_where_a_lost_driver_left_it(spark, store):
    log = jobs.JobLog(store, 0.5)
    job, ran = log.submit("skew", [("s", "a"), ("s", "b"), ("s", "c")]), []
    items = log.items(job)
    log.leases.claim(f"job-{job}")
    log.record(job, "running")
    log.record(job, "done", items[0]["id"])
    log.record(job, "running", items[1]["id"])  # and then the driver went
    other = jobs.JobLog(store)
    assert other.run(job, lambda *a: ran.append(a[2])) == "taken"
    time.sleep(0.6)
    assert other.run(job, lambda *a: ran.append(a[2])) == "done" and ran == ["b", "c"]


def test_one_rewrite_of_a_table_at_a_time(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS leased")
    layout.write_layout(spark.range(40), "leased.t", "RANDOM", n=2)
    other = layout.claims(spark.newSession())
    with other.held("leased.t"):
        layout.write_layout(spark.range(7), "leased.t_new_0123abce", "RANDOM", n=1)  # that driver's staged copy
        refused = layout.relayout(spark, "leased.t", "HASH", ["id"], 4)
        assert not refused["ok"] and refused["message"] == "Table is being rewritten" and spark.table("leased.t_new_0123abce").count() == 7
    assert layout.relayout(spark, "leased.t", "HASH", ["id"], 4)["ok"] and spark.table("leased.t").count() == 40


# guarded transitions


def _plain(events):
    """Fold by looking at one event after the other."""
    out = {}
    for job, _, event in sorted(events):
        state, refused = out.get(job, ("", 0))
        known = event in machine.JOB.moves
        out[job] = (event, refused) if known and machine.JOB.allows(event, state) else (state, refused + 1)
    return out


@pytest.mark.parametrize("width", [None, 1, 7])
def test_fold_equals_one_event_after_the_other(spark, width):
    rng = random.Random(3)
    names = [*machine.JOB.moves, "unknown"]
    events = [(rng.randrange(12), i, rng.choice(names)) for i in range(700)]
    frame = spark.createDataFrame(events, "job_id int, seq long, event string").repartition(5)
    chunk = None if width is None else F.floor(F.col("seq") / width)
    found = machine.fold(frame, machine.JOB, ["job_id"], ["seq"], ("seq",), chunk)
    assert {r.job_id: (r.status, r.rejected) for r in found.collect()} == _plain(events)
    assert machine.fold(frame.where("false"), machine.JOB, ["job_id"], ["seq"], chunk=chunk).isEmpty()


def test_the_last_accepted_event_gives_time_and_message(spark):
    rows = [(1, None, 1, "running", "2024-01-01 00:00:00", "a"), (1, None, 2, "cancelled", "2024-01-01 00:00:05", "b"), (1, None, 3, "done", "2024-01-01 00:00:09", "c"), (1, None, 4, "stopping", "2024-01-01 00:00:10", "d")]
    events = spark.createDataFrame(rows, "job_id long, item_id long, seq long, event string, at string, message string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    one = jobs.job_states(events).first()
    assert (one.status, one.message, one.rejected, str(one.started_at), str(one.finished_at)) == ("cancelled", "b", 2, "2024-01-01 00:00:00", "2024-01-01 00:00:05")


# hierarchies, profiles, layouts, service


def test_positions_without_one_task(spark):
    from tablehealth.operators.ranking import numbered

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("position_")).repartition(7)
    found = numbered(df, F.desc("k"))
    assert found.count() == 5000 and found.where("k + position <> 5000").isEmpty()
    assert numbered(df.where("false"), F.col("k")).isEmpty()


def test_durations_where_clocks_change(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    from tablehealth.functions import expressions as X

    rows = [("2024-03-31 01:00:00", "2024-03-31 04:00:00.125"), ("2024-10-27 01:00:00", "2024-10-28 01:00:00"), ("2024-01-02 00:00:00", "2024-01-01 23:59:00"), (None, "2024-01-01 00:00:00")]
    df = own.createDataFrame(rows, "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert [r[0] for r in df.select(X.seconds_between(F.col("a"), F.col("b"))).collect()] == [10800.13, 86400.0, -60.0, None]


def test_deep_and_shared_hierarchies(spark):
    chain = spark.range(2500).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("parent"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("child"))
    roots = spark.createDataFrame([("n0",), ("n2400",), ("alone",)], "node string")
    assert hierarchy.walk(chain, roots).groupBy("root").agg(F.max("level_no").alias("m"), F.count("*").alias("n")).orderBy("root").collect() == [("alone", 0, 1), ("n0", 2500, 2501), ("n2400", 100, 101)]
    diamond = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e")], "parent string, child string")
    found = hierarchy.walk(diamond, spark.createDataFrame([("a",)], "node string"))
    assert sorted((r.node, r.level_no) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 1), ("e", 3)]
    assert hierarchy.walk(diamond.where("false"), spark.createDataFrame([("a",)], "node string")).count() == 1


def test_thinned_hierarchies_lose_nothing(spark, monkeypatch):
    """Chains, stars, trees and shared nodes, thinned to a few edges first, against a plain walk."""
    draw = random.Random(3)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(300)] + [(f"c{i}", f"side{i}") for i in range(0, 300, 3)]
    shared = [(f"s{i}", f"s{j}") for i in range(40) for j in range(i + 1, min(i + 4, 40)) if draw.random() < 0.5]
    tree = [(f"t{draw.randrange(i)}", f"t{i}") for i in range(1, 200)]
    edges = [("top", "c0"), ("top", "s0"), ("top", "t0"), ("c300", "s1")] + chain + shared + tree
    tops = ["top", "c150", "s3", "side9", "nowhere", "t1"]
    below = {}
    for p, c in edges:
        below.setdefault(p, []).append(c)
    expected = set()
    for top in tops:
        level, nodes = 0, {top}
        while nodes:
            expected |= {(top, n, level) for n in nodes}
            level, nodes = level + 1, {c for n in nodes for c in below.get(n, [])}
    rounds = []
    plain = hierarchy._doubled
    monkeypatch.setattr(hierarchy, "_doubled", lambda found, left, gone, stage: rounds.append((left.count(), len(gone))) or plain(found, left, gone, stage))
    frame, roots = spark.createDataFrame(edges + edges[:9], "parent string, child string"), spark.createDataFrame([(t,) for t in tops], "node string")
    found = hierarchy.walk(frame, roots, small=100)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert rounds[0][0] < len(set(edges)) / 2 and rounds[0][1] > 1  # and little was left to double
    assert dict(found.dtypes)["level_no"] == "int"
    ring = [(f"r{i:02}", f"r{(i + 1) % 60:02}") for i in range(60)] + [("in", "r07"), ("r30", "out"), ("out", "end")]
    with pytest.raises(hierarchy.CycleError) as error:
        hierarchy.walk(spark.createDataFrame(ring, "parent string, child string"), spark.createDataFrame([("in",)], "node string"), small=4)
    assert error.value.nodes == [f"r{i:02}" for i in range(20)]


def test_sketches_reject_and_exact_checks_decide(spark):
    n = 20_000
    df = spark.range(n).select("id", (F.col("id") % 19_000).alias("near"), F.when(F.col("id") > 5, F.col("id")).alias("gap"), F.lit("x").alias("one"), F.col("id").cast("string").alias("text"))
    found = profile.screen(df, df.columns)
    assert [c for c, x in found.items() if profile.may_be_unique(*x)] == ["id", "near", "text"]
    assert profile.is_unique(df, "id") and not profile.is_unique(df, "near")
    assert profile.find_unique_column(df, ["one", "near", "gap", "text", "id"])["column"] == "text"
    assert profile.find_unique_column(df.select("one"), ["one"]) is None


def test_sizes_come_from_listings(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "a b%c"))
    df = spark.read.parquet(str(tmp_path / "a b%c"))
    plain = sum(p.stat().st_size for p in (tmp_path / "a b%c").glob("*.parquet"))
    assert tuple(catalog.table_bytes(df).first()) == (plain, 3)
    assert tuple(catalog.table_bytes(spark.range(3)).first()) == (0, 0)


def test_counts_by_file_and_bucket_read_no_column(spark, sf_dir):
    from tablehealth.operators import skew
    from tablehealth.sources import segments

    plan = skew.segment_counts(spark.read.parquet(f"{sf_dir}/orders.parquet"), segments.by_file())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_only_partitions_with_small_files_are_rewritten(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS partly")
    rows = spark.range(900).select("id", (F.col("id") % 3).alias("p"), (F.col("id") % 7).alias("spread"))
    rows.repartition(20, F.when(F.col("p") == 2, 0).otherwise(F.col("spread"))).drop("spread").write.partitionBy("p").saveAsTable("partly.t")
    before = catalog.file_sizes(spark.table("partly.t"))
    alone = {f for f in before if "/p=2/" in f}
    assert len(alone) == 1 and len(before) > 9
    done = layout.compact(spark, "partly.t")
    assert done["ok"] and (done["partitions"], done["files_after"]) == (2, 2), done
    after = catalog.file_sizes(spark.table("partly.t"))
    assert alone <= set(after) and len(after) == 3
    assert spark.table("partly.t").agg(F.count("*"), F.sum("id"), F.sum("p")).first() == rows.agg(F.count("*"), F.sum("id"), F.sum("p")).first()
    assert layout.compact(spark, "partly.t")["message"] == "Nothing to rewrite"
    layout.write_layout(spark.range(5), "partly.plain", "RANDOM", n=2)
    assert not layout.compact(spark, "partly.plain")["ok"] and spark.table("partly.plain").count() == 5


def test_each_merged_file_has_its_own_task(spark):
    """As many files as the bytes fill: none of two that met in one task, and no sort of a whole partition."""
    spark.sql("CREATE DATABASE IF NOT EXISTS partly")
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") % 3).alias("p"))
    rows.repartition(20).write.partitionBy("p").saveAsTable("partly.even")
    before = catalog.file_sizes(spark.table("partly.even"))
    wanted = sum(before.values()) // 24
    held = {}
    for name, size in before.items():
        held[name.rpartition("/")[0]] = held.get(name.rpartition("/")[0], 0) + size
    done = layout.compact(spark, "partly.even", wanted)
    assert done["ok"] and done["files_after"] == sum(-(-n // wanted) for n in held.values()) > 20, done
    assert max(catalog.file_sizes(spark.table("partly.even")).values()) < 1.5 * wanted
    assert spark.table("partly.even").exceptAll(rows.select("id", "text", "p")).isEmpty() and spark.table("partly.even").count() == 60_000


def test_compaction_of_orders_with_several_whole_files(spark, monkeypatch):
    """The partition that stays is cut into files too large to be merged."""
    sf_dir = "/root/testdata/sf0.01"
    monkeypatch.setattr(layout, "FILE_BYTES", 32 << 10)
    monkeypatch.setattr(layout.compact, "__defaults__", (32 << 10,))
    spark.sql("CREATE DATABASE IF NOT EXISTS partly")
    monkeypatch.setattr(catalogue, "_scratch", lambda spark: "partly.orders")
    found = tuple(catalogue.queries()["layout_compact"](spark, sf_dir).first())
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert found == tuple(orders.agg(F.count("*"), F.sum("o_orderkey"), F.count_distinct("o_orderstatus") - 1).first())
    assert sum("o_orderstatus=P/" in f for f in catalog.file_sizes(spark.table("partly.orders"))) > 1
    assert spark.table("partly.orders").select(*orders.columns).exceptAll(orders).isEmpty()


def test_one_recommendation_scans_one_table(spark, tmp_path, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS advice")
    for name in ("a", "b"):
        layout.write_layout(spark.range(50).selectExpr("id AS k", "id % 2 AS v"), f"advice.{name}", "RANDOM", n=2)
        layout.maintain(spark, f"advice.{name}", "analyze")
    scanned, screen = [], profile.screen
    monkeypatch.setattr(profile, "screen", lambda df, columns: scanned.append(columns) or screen(df, columns))
    described = []
    monkeypatch.setattr(catalog, "describe", lambda s, t, f=catalog.describe: described.append(t) or f(s, t))
    status, reply = Service(spark, stores.Store(spark, str(tmp_path))).recommendation("advice", "b")
    assert status == 200 and reply["source_column"] == "k" and len(scanned) == 1 and set(described) == {"advice.b"}


def test_skew_of_files_is_stored_without_the_driver(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS many")
    layout.write_layout(spark.range(300), "many.t", "RANDOM", n=6)
    store = stores.Store(spark, str(tmp_path / "s"))
    store.bootstrap()
    service = Service(spark, store)
    job = service.start_skew([{"schema": "many", "table": "t"}], wait=True)[1]["job_id"]
    assert service.job(job)[1]["job"]["status"] == "done", service.job_items(job)
    parts = store.read("skew_result_segments").collect()
    assert sorted(r.segment_id for r in parts) == list(range(6)) and sum(r.row_count for r in parts) == 300
    assert store.read("skew_results").first().total_rows == 300 and len({r.id for r in parts}) == 6


def test_every_derived_case_has_rows(spark, sf_dir):
    for name in derived.RELATIONS:
        assert not derived.frame(spark, sf_dir, name).isEmpty(), name
    kinds = {r.status for r in derived.frame(spark, sf_dir, "results").select("status").distinct().collect()}
    assert None in kinds and "ODD" in kinds
    assert set(profile.eligible(spark.read.parquet(f"{sf_dir}/orders.parquet"))) == set(catalogue._SCANNED["orders"].split())


def test_jdbc_parts_and_pushed_filters(spark, sf_dir):
    df = catalogue.queries()["jdbc_round_trip"](spark, sf_dir)
    assert df.rdd.getNumPartitions() >= 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(o_totalprice), *GreaterThan(o_totalprice,1000.0)]" in plan or "GreaterThan(o_totalprice" in plan
