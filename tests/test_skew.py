import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehealth.operators import history, skew
from tablehealth.sources import segments

COLUMNS = "total_rows", "segment_count", "avg_rows", "max_rows", "min_rows", "skew_ratio", "empty_segments", "status"

GOLDEN = [
    ([100, 100, 100, 100], (400, 4, 100.0, 100, 100, 1.0, 0, "OK")),
    ([149, 51, 100, 100], (400, 4, 100.0, 149, 51, 1.49, 0, "OK")),
    ([150, 50, 100, 100], (400, 4, 100.0, 150, 50, 1.5, 0, "WARNING")),
    ([299, 21, 40, 40], (400, 4, 100.0, 299, 21, 2.99, 0, "WARNING")),
    ([300, 20, 40, 40], (400, 4, 100.0, 300, 20, 3.0, 0, "CRITICAL")),
    ([97, 1, 1, 1], (100, 4, 25.0, 97, 1, 3.88, 0, "CRITICAL")),
    ([1, 1, 2], (4, 3, 1.33, 2, 1, 1.5, 0, "WARNING")),
    ([7, 3, 3], (13, 3, 4.33, 7, 3, 1.6154, 0, "WARNING")),
    ([149996, 50004], (200000, 2, 100000.0, 149996, 50004, 1.5, 0, "OK")),
    ([1000], (1000, 1, 1000.0, 1000, 1000, 1.0, 0, "OK")),
    ([], (0, 0, 0.0, 0, 0, 0.0, 0, "EMPTY")),
    ([0, 0], (0, 2, 0.0, 0, 0, 0.0, 2, "EMPTY")),
    ([10, 0, 5], (15, 3, 5.0, 10, 0, 2.0, 1, "WARNING")),
]


def counted(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "segment_id int, row_count long")


def test_golden_statistics(spark):
    table = spark.createDataFrame([(i, n, k) for i, (rows, _) in enumerate(GOLDEN) for k, n in enumerate(rows)], "case int, row_count long, segment_id int")
    found = {r.case: tuple(r[c] for c in COLUMNS) for r in skew.statistics(table, ("case",)).collect()}
    for i, (rows, expected) in enumerate(GOLDEN):
        if rows:
            assert found[i] == expected
    assert tuple(skew.statistics(counted(spark, [])).first()[c] for c in COLUMNS) == GOLDEN[10][1]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12), st.randoms())
def test_properties(spark, rows, rng):
    one = skew.statistics(counted(spark, rows)).first()
    assert one.total_rows == sum(rows) and 0 <= one.empty_segments <= len(rows)
    assert one.skew_ratio >= 1 if sum(rows) else one.status == "EMPTY"
    mixed = rows[:]
    rng.shuffle(mixed)
    assert skew.statistics(counted(spark, mixed)).first() == one
    seen = skew.statistics(counted(spark, [n for n in rows if n])).first()
    assert one.skew_ratio >= seen.skew_ratio or not sum(rows)


def test_declared_segments_fill_with_zeros(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "k int")
    found = {r.segment_id: r.row_count for r in skew.segment_counts(df, F.col("k"), 4).collect()}
    assert found == {0: 2, 1: 0, 2: 1, 3: 0}
    assert skew.analyze(df, F.col("k"), 4).first().skew_ratio > skew.analyze(df, F.col("k")).first().skew_ratio


def test_null_segment_is_a_segment(spark):
    df = spark.createDataFrame([(None,), (1,)], "k int")
    assert skew.analyze(df, F.col("k")).first().segment_count == 2


def test_one_failure_does_not_stop_the_rest(spark):
    df = spark.range(10)
    found = {r.table_name: r for r in skew.analyze_many({"good": (df, F.col("id") % 2), "bad": (df, F.col("nope")), "gone": (lambda: spark.table("no_such_table"), F.col("x"))}).collect()}
    assert found["good"].status == "OK" and found["good"].error is None
    assert found["bad"].status == found["gone"].status == "FAILED" and found["bad"].error and found["gone"].error


def test_nested_segments(spark):
    one = skew.with_segments(spark.range(10), F.col("id") % 3).first()
    assert [(s.segment_id, s.row_count) for s in one.segments] == [(0, 4), (1, 3), (2, 3)]


def test_plan_is_one_partial_aggregate_over_the_key_alone(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = skew.analyze(df, segments.by_modulo("l_suppkey", 8))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan
    assert "partial_count" in plan and "Python" not in plan


def results(spark):
    rows = [(1, "s", "a", 10, 1.0, "OK"), (2, "s", "b", 10, 3.5, "CRITICAL"), (3, "s", "c", 20, 3.5, "CRITICAL"), (4, "s", "d", 5, 1.6, "WARNING"), (5, "s", "e", 0, 0.0, "EMPTY"), (6, "s", "f", None, None, None)]
    return spark.createDataFrame(rows, "id long, schema_name string, table_name string, total_rows long, skew_ratio double, status string")


def test_ranking_and_limits(spark):
    df = results(spark)
    order = lambda f: [r.id for r in f.orderBy("position").collect()]
    assert order(history.ranked(df)) == [3, 2, 4, 1, 5, 6]
    assert order(history.ranked(df, 2)) == [3, 2]
    assert order(history.ranked(df, -1)) == order(history.ranked(df, None)) == [3, 2, 4, 1, 5, 6]
    assert order(history.problems(df)) == [3, 2, 4]
    assert order(history.top(df, 3)) == [3, 2, 4]
    assert [history.parse_limit(x) for x in ("7", "x", None, "-1")] == [7, 100, 100, -1]


def test_ranking_takes_the_top_without_a_full_sort(spark):
    plan = history.ranked(results(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_summary(spark):
    one = history.summarize(results(spark), spark.createDataFrame([("interrupted",), ("done",)], "status string")).first()
    assert (one.total_tables, one.max_skew, one.avg_skew) == (6, 3.5, pytest.approx(1.92))
    assert (one.ok, one.warning, one.critical, one.empty, one.failed, one.interrupted) == (1, 1, 2, 1, 1, 1)
    none = history.summarize(results(spark).where("false")).first()
    assert (none.total_tables, none.max_skew, none.avg_skew, none.ok) == (0, 0.0, 0.0, 0)


def test_drill_down_nests_in_order(spark):
    parts = spark.createDataFrame([(1, 2, 5), (1, 0, 3), (1, 1, 2)], "skew_result_id long, segment_id int, row_count long")
    rows = {r.id: r.segments for r in history.drill_down(results(spark), parts).collect()}
    assert [s.segment_id for s in rows[1]] == [0, 1, 2] and rows[2] is None


def test_heat(spark):
    df = spark.createDataFrame([(0, 100), (1, 80), (2, 79), (3, 0)], "segment_id int, row_count long")
    assert [r.heat for r in history.heat(df).orderBy("segment_id").collect()] == ["hot", "hot", "normal", "empty"]
