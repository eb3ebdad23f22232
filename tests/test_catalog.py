import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehealth.functions import expressions as X
from tablehealth.operators import hierarchy, layout, profile, recommend
from tests import fixtures
from tablehealth import service
from tablehealth.sources import catalog, store


def test_distribution_key_parsing(spark):
    cases = {None: None, "": [], " ": [], "{}": [], "{1,2}": [1, 2], "{ 2 , x,,1}": [2, 1], "7": [7], "1 2": [], "abc": []}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    for r in df.select("k", X.parse_distribution_key(F.col("k")).alias("v"), X.parse_distribution_key(F.col("k"), spaces=True).alias("w")).collect():
        assert (r.v or []) == (cases[r.k] or [])
        assert r.k != "1 2" or r.w == [1, 2]


def test_quotes_are_doubled(spark):
    one = spark.range(1).select(X.distribution_preview(F.lit('a"b'), F.lit("t"), F.lit("HASH"), F.array(F.lit("c"), F.lit("d"))).alias("s")).first()
    assert one.s == 'ALTER TABLE "a""b"."t" SET WITH (REORGANIZE=true) DISTRIBUTED BY ("c", "d");'


def test_candidate_order_and_skips(spark):
    live = [("s", "t", n, "int4", nn, i, False) for i, (n, nn) in enumerate([("a", True), ("b", True), ("c", False), ("d", True), ("e", False), ("f", True)], 1)]
    attributes = spark.createDataFrame(live, "schemaname string, tablename string, attname string, typname string, attnotnull boolean, attnum int, attisdropped boolean")
    found = profile.candidates(attributes, fixtures.frame(spark, "column_stats").withColumn("schemaname", F.lit("s")).withColumn("tablename", F.lit("t")).where("attname <> 'host'")).orderBy("position").collect()
    assert [(r.attname, r.skipped) for r in found] == [("a", False), ("b", False), ("f", False), ("d", True), ("e", True), ("c", False)]
    loose = profile.candidates(attributes, fixtures.frame(spark, "column_stats").where("false"), scan_without_stats=True).collect()
    assert not any(r.skipped for r in loose)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", -0.0), (3, None, float("nan"))], "k int, t string, x double")
    found = {r.column_name: (r.total_rows, r.not_null_rows, r.distinct_rows, r.is_unique) for r in profile.profile(df, ["k", "t", "x"]).collect()}
    assert found == {"k": (3, 3, 3, True), "t": (3, 2, 1, False), "x": (3, 3, 2, False)}
    assert profile.find_unique_column(df, ["t", "x", "k"])["column"] == "k"
    assert profile.find_unique_column(df, ["t", "x"]) is None
    assert profile.find_unique_column(df.where("false"), ["k"]) is None


def test_recommendation_scans_tables_without_an_index(spark):
    found = fixtures.as_catalog(spark)
    tables = {("dwh", "plain"): spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 2)], "a int, b int, f int, c int"), ("dwh", "logs"): spark.createDataFrame([("x",), ("x",)], "host string")}
    scanned = recommend.scan_tables(found, lambda s, t: tables[s, t])
    assert [tuple(r) for r in scanned.collect()] == [("dwh", "plain", "a")]
    rows = {r.table_name: r for r in recommend.recommend(found, scanned).collect()}
    assert rows["orders"].already_same and rows["orders"].source_index == "orders_pkey"
    assert rows["customers"].recommended_columns == ["c_name"] and not rows["customers"].already_same
    assert rows["plain"].recommended_columns == ["a"] and rows["plain"].source_column == "a"
    assert rows["logs"].recommendation_type == "RANDOM" and not rows["logs"].already_same
    assert rows["fact"].already_same


def test_object_tree(spark):
    tree = hierarchy.object_tree(fixtures.as_catalog(spark))
    assert {r.full_name for r in tree.collect()} == {"sales.orders", "sales.customers", "sales.codes", "dwh.fact", "dwh.logs", "dwh.plain"}
    assert {r.full_name for r in hierarchy.search(tree, "DWH").collect()} == {"dwh.fact", "dwh.logs", "dwh.plain"}
    assert hierarchy.search(tree, "  ").count() == 6
    nested = {r["schema"]: [t.table for t in r.tables] for r in hierarchy.nested_tree(tree).collect()}
    assert nested["sales"] == ["codes", "customers", "orders"]
    assert "BroadcastHashJoin" in tree._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), min_size=1, max_size=8))
def test_leaves_of_any_tree(spark, parents):
    edges = [(f"n{min(p, i)}", f"n{i + 1}") for i, p in enumerate(parents)]
    frame, roots = spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("n0",)], "node string")
    inner = {p for p, _ in edges}
    found = {r.node for r in hierarchy.leaves(frame, roots).collect()}
    assert found == ({c for _, c in edges} | {"n0"}) - inner
    once = hierarchy.expand(frame, spark.createDataFrame([(1, "n0"), (2, "n0")], "pos int, node string"))
    assert sorted(r.node for r in once.collect()) == sorted(found)


def test_a_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(hierarchy.CycleError, match="cycle among a, b") as error:
        hierarchy.leaves(edges, spark.createDataFrame([("a",)], "node string"))
    assert error.value.nodes == ["a", "b"]


def test_layouts_and_upkeep(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lay")
    df = spark.range(400).withColumn("k", F.col("id") % 3)
    layout.write_layout(df, "lay.t", "HASH", ["k"], 4)
    assert catalog.describe(spark, "lay.t")["columns"] == ["k"]
    before = layout.bucket_skew(spark, "lay.t").first()
    assert layout.reorganize(spark, "lay.t")["ok"]
    assert layout.bucket_skew(spark, "lay.t").first() == before
    done = layout.relayout(spark, "lay.t", " hash ", ["id"], 4)
    assert done["status"] == "SUCCESS" and spark.table("lay.t").count() == 400
    assert layout.bucket_skew(spark, "lay.t").first().skew_ratio < before.skew_ratio
    assert layout.relayout(spark, "lay.t", "RANDOM", n=2)["ok"] and catalog.describe(spark, "lay.t")["distribution"] == "RANDOM"
    assert layout.relayout(spark, "lay.t", "REPLICATED")["ok"]
    assert layout.relayout(spark, "lay.t", "HASH")["status"] == "FAILED"
    assert layout.relayout(spark, "lay.t", "SPIRAL")["status"] == "FAILED" and spark.table("lay.t").count() == 400
    assert layout.reorganize(spark, "lay.none")["status"] == "NOT_FOUND"
    for kind in layout.MAINTENANCE:
        assert layout.maintain(spark, "lay.t", kind)["ok"]
    assert {r.attname for r in layout.column_statistics(spark, "lay.t").collect()} == {"id", "k"}
    with pytest.raises(ValueError):
        layout.maintain(spark, "lay.t", "polish")
    tree = hierarchy.object_tree(catalog.from_spark(spark))
    assert "lay.t" in {r.full_name for r in tree.collect()}
    size = catalog.table_bytes(spark.table("lay.t")).first()
    assert size.files == 1 and size.total_bytes > 0


def test_data_scan_tries_every_column_of_lineitem(spark, sf_dir, tmp_path):
    from tablehealth.plans import catalogue

    for name in ("orders", "customer", "supplier", "documents", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert profile.find_unique_column(lines, [c for c in lines.columns if c != "l_comment"]) is None
    lines.withColumn("l_comment", F.concat(F.lit("line "), F.monotonically_increasing_id())).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r.table_name: r.source_column for r in catalogue.queries()["unique_scan"](spark, str(tmp_path)).where("table_name <> 'conversations'").collect()}
    assert found == {"orders": "o_orderkey", "lineitem": "l_comment", "customer": "c_custkey", "supplier": "s_suppkey", "documents": "doc_id"}


def test_a_swap_that_a_lost_driver_left_is_put_right(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lost")
    layout.write_layout(spark.range(40), "lost.t", "RANDOM", n=2)
    assert layout.recover(spark, "lost.t") == "nothing"
    spark.sql("ALTER TABLE lost.t RENAME TO lost.t_old_0123abcd")  # and then the driver went
    layout.write_layout(spark.range(7), "lost.t_new_0123abce", "RANDOM", n=1)
    assert layout.relayout(spark, "lost.t", "HASH", ["id"], 4)["ok"]
    assert spark.table("lost.t").count() == 40 and [t.name for t in spark.catalog.listTables("lost") if not t.isTemporary] == ["t"]
    layout.write_layout(spark.range(3), "lost.t_old_0123abcf", "RANDOM", n=1)
    assert layout.recover(spark, "lost.t") == "cleaned" and spark.table("lost.t").count() == 40


def test_catalog_of_the_session_has_sizes_types_and_statistics(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS live")
    layout.write_layout(spark.range(500).selectExpr("id AS a", "id % 3 AS b", "CAST(id AS DECIMAL(9, 2)) AS c"), "live.t", "RANDOM", n=2)
    assert catalog.from_spark(spark).column_stats.where("tablename = 't' AND schemaname = 'live'").isEmpty()
    layout.maintain(spark, "live.t", "analyze")
    found = catalog.from_spark(spark)
    row = found.relations.where("relname = 't'").join(found.namespaces.where("nspname = 'live'"), found.relations.relnamespace == found.namespaces.oid).first()
    assert row.reltuples == 500 and row.total_bytes > 0
    stats = {r.attname: (r.n_distinct, r.null_frac) for r in found.column_stats.where("schemaname = 'live'").collect()}
    assert set(stats) == {"a", "b", "c"} and stats["b"] == (3.0, 0.0)
    assert {r.typname for r in found.attributes.where("attname = 'c'").collect()} >= {"numeric"}
    status, reply = service.Service(spark, store.Store(spark, str(tmp_path)), lambda *only: found).recommendation("live", "t")
    assert (status, reply["recommendation_type"]) == (200, "HASH") and reply["source_column"] in ("a", "c")
