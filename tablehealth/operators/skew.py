"""Distribution skew: rows per segment, statistics, ratio and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed thresholds on the unrounded ratio max/avg.
WARNING_FROM = 1.5
CRITICAL_FROM = 3.0


def segment_counts(df: DataFrame, segment: Column, segments: int | None = None) -> DataFrame:
    """One row per segment: (segment_id, row_count).

    ``segments=None`` observes only segments that hold rows.  With a declared number
    of segments the ids 0..segments-1 appear as well, with zero rows where none exist.
    """
    counts = df.groupBy(segment.alias("segment_id")).agg(F.count(F.lit(1)).alias("row_count"))
    if segments is None:
        return counts
    every = df.sparkSession.range(segments).select(F.col("id").alias("segment_id"))
    counts = counts.withColumn("segment_id", F.col("segment_id").cast("long"))
    return (
        every.join(counts, "segment_id", "full")
        .select("segment_id", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"))
    )


def status(total: Column, ratio: Column) -> Column:
    """OK below 1.5, WARNING below 3.0, else CRITICAL; EMPTY without rows."""
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, "EMPTY")
        .when(ratio < WARNING_FROM, "OK")
        .when(ratio < CRITICAL_FROM, "WARNING")
        .otherwise("CRITICAL")
    )


def color_band(rounded_ratio: Column) -> Column:
    """Display band of the ratio as shown, so after rounding."""
    return (
        F.when(rounded_ratio >= CRITICAL_FROM, "red")
        .when(rounded_ratio >= WARNING_FROM, "amber")
        .otherwise("green")
    )


def statistics(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fold (segment_id, row_count) rows into one row of statistics per ``by`` group."""
    n = F.col("row_count")
    grouped = counts.groupBy(*by) if by else counts
    folded = grouped.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_rows"),
        F.count(n).alias("segment_count"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_rows"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_rows"),
        F.coalesce(F.sum(F.when(n == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("empty_segments"),
    )
    ratio = F.when(F.col("mean") > 0, F.col("max_rows") / F.col("mean")).otherwise(0.0)
    return folded.withColumn("ratio", ratio).select(
        *by,
        "total_rows",
        "segment_count",
        F.round("mean", 2).alias("avg_rows"),
        "max_rows",
        "min_rows",
        F.round("ratio", 4).alias("skew_ratio"),
        "empty_segments",
        status(F.col("total_rows"), F.col("ratio")).alias("status"),
    )


def analyze(df: DataFrame, segment: Column, segments: int | None = None) -> DataFrame:
    """Skew of one table as one row."""
    return statistics(segment_counts(df, segment, segments))


def analyze_many(tables: dict[str, tuple], failed: dict[str, str] | None = None) -> DataFrame:
    """One row per named (frame, segment): all tables in one plan.

    A table that cannot be resolved gives a FAILED row with its error and does not stop
    the others.  Frames may be given as functions, so that opening one can fail too.
    """
    frames, errors, spark = [], dict(failed or {}), None
    for name, (frame, segment) in tables.items():
        try:
            df = frame() if callable(frame) else frame
            one = analyze(df, segment).withColumn("table_name", F.lit(name)).withColumn("error", F.lit(None).cast("string"))
            one.schema  # resolves the plan
            frames.append(one)
            spark = df.sparkSession
        except Exception as error:  # the row carries the failure
            errors[name] = str(error).splitlines()[0]
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    columns = "table_name string, total_rows long, segment_count long, avg_rows double, max_rows long, min_rows long, skew_ratio double, empty_segments long, status string, error string"
    bad = spark.createDataFrame([(name, *[None] * 7, "FAILED", text) for name, text in errors.items()], columns)
    for one in frames:
        bad = bad.unionByName(one)
    return bad


def top_segments(counts: DataFrame, most: int = 1000) -> DataFrame:
    """The fullest segments, at most so many, by count and then id: what a reply can carry."""
    return counts.orderBy(F.desc("row_count"), F.asc("segment_id")).limit(most)


def with_segments(df: DataFrame, segment: Column, segments: int | None = None) -> DataFrame:
    """The statistics of ``analyze`` with all segments nested in order: for declared or few segments.

    Where their number is unknown, store ``segment_counts`` and show ``top_segments``.
    """
    counts = segment_counts(df, segment, segments)
    nested = counts.agg(F.array_sort(F.collect_list(F.struct("segment_id", "row_count"))).alias("segments"))
    return statistics(counts).join(nested, F.lit(True))
