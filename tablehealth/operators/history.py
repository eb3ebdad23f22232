"""Result history: ranking, problem lists, summaries, drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.functions import expressions as X
from tablehealth.operators.ranking import numbered

RESULT_ORDER = (F.desc, "skew_ratio"), (F.desc, "total_rows"), (F.asc, "schema_name"), (F.asc, "table_name")


def _ordered(df: DataFrame, *first) -> DataFrame:
    return df.orderBy(*first, *[way(name) for way, name in RESULT_ORDER])


def parse_limit(text: str | None, default: int = 100) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def ranked(results: DataFrame, limit: int | None = 500) -> DataFrame:
    """Most severe first, then by ratio, rows and name; ``position`` shows the order.

    A negative or missing limit is none.
    """
    order = [F.asc("_rank"), *[way(name) for way, name in RESULT_ORDER]]
    marked = results.withColumn("_rank", X.severity_rank(F.col("status")))
    if limit is None or limit < 0:
        return numbered(marked, *order).drop("_rank")
    top = marked.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("_rank")


def problems(results: DataFrame, limit: int | None = 500) -> DataFrame:
    """Critical and warning tables alone, ranked."""
    return ranked(results.where(F.col("status").isin("CRITICAL", "WARNING")), limit)


def of_job(results: DataFrame, job_id: int) -> DataFrame:
    return _ordered(results.where(F.col("job_id") == job_id))


def latest(results: DataFrame, jobs: DataFrame, job_type: str = "skew") -> DataFrame:
    """Results of the newest job of a type, whatever became of it; all results if there is none."""
    newest = jobs.where(F.col("job_type") == job_type).agg(F.max("id").alias("_latest"))
    joined = results.join(F.broadcast(newest), F.lit(True))
    return joined.where(F.col("_latest").isNull() | (F.col("job_id") == F.col("_latest"))).drop("_latest")


def top(results: DataFrame, k: int = 20) -> DataFrame:
    """The k highest ratios with their position and colour band."""
    order = [way(name) for way, name in RESULT_ORDER]
    return results.orderBy(*order).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def summarize(results: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """total_tables, max_skew, avg_skew and one count per status, in one row.

    A missing status counts as FAILED; INTERRUPTED counts job items.  Every status has
    its count, zero if need be.
    """
    status = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("FAILED"))
    counts = [F.count_if(status == s).alias(s.lower()) for s in X.SUMMARY_STATUSES if s != "INTERRUPTED"]
    ratio = F.col("skew_ratio")
    folded = results.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.round(F.greatest(F.coalesce(F.max(ratio), F.lit(0.0)), F.lit(0.0)), 4).alias("max_skew"),
        F.round(F.coalesce(F.avg(ratio), F.lit(0.0)), 4).alias("avg_skew"),
        *counts,
    )
    if items is None:
        return folded.withColumn("interrupted", F.lit(0).cast("long"))
    return folded.join(F.broadcast(items.agg(F.count_if(F.col("status") == "interrupted").alias("interrupted"))), F.lit(True))


def status_counts(results: DataFrame) -> DataFrame:
    """The summary's counts as one map, statuses outside the vocabulary included."""
    known = results.sparkSession.createDataFrame([(s, 0) for s in X.SUMMARY_STATUSES], "status string, n long")
    found = results.groupBy(F.coalesce("status", F.lit("FAILED")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    both = known.unionByName(found).groupBy("status").agg(F.sum("n").alias("n"))
    return both.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))


def segment_detail(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Header columns beside each of its segments, in segment order."""
    header = results.select(F.col("id").alias("skew_result_id"), "status", "skew_ratio", "total_rows")
    return segments.select("skew_result_id", "schema_name", "table_name", "segment_id", "row_count").join(header, "skew_result_id").orderBy("skew_result_id", "segment_id")


def drill_down(results: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per result with its segments nested, ordered by segment."""
    nested = segments.groupBy("skew_result_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "row_count"))).alias("segments"))
    return results.join(nested, F.col("id") == F.col("skew_result_id"), "left").drop("skew_result_id")


def heat(counts: DataFrame, by: tuple[str, ...] = (), hot_from: float = 0.8) -> DataFrame:
    """Flags segments: empty without rows, hot from ``hot_from`` of the group's peak on."""
    if by:
        peak = F.max("row_count").over(Window.partitionBy(*by))
        counts = counts.withColumn("_peak", peak)
    else:
        counts = counts.join(F.broadcast(counts.agg(F.max("row_count").alias("_peak"))), F.lit(True))
    least = F.greatest(F.col("_peak"), F.lit(1))
    return counts.withColumn("heat", F.when(F.col("row_count") == 0, "empty").when(F.col("row_count") >= hot_from * least, "hot").otherwise("normal")).drop("_peak")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
