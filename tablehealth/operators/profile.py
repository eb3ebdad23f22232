"""Uniqueness profiling: candidates by statistics, sketches that reject, exact checks of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.functions import expressions as X

ELIGIBLE = (T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.StringType, T.VarcharType, T.CharType, T.DateType, T.TimestampType, T.TimestampNTZType)
MAX_CANDIDATES = 20
#: Relative standard deviation of the distinct sketches, and how many of them an estimate may fall short by.
SKETCH_ERROR = 0.02
SKETCH_DEVIATIONS = 8


def eligible(df: DataFrame) -> list[str]:
    """Columns whose type can be a distribution key."""
    return [f.name for f in df.schema if isinstance(f.dataType, ELIGIBLE)]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, total_rows, not_null_rows, distinct_rows, is_unique: one row per column, exact.

    Each column is read and counted by itself, by value in its own type and with partial
    sums: a column of few values hardly shuffles, no value becomes text, and a columnar
    source reads each column once all the same.
    """
    empty = df.sparkSession.createDataFrame([], "column_name string, total_rows long, not_null_rows long, distinct_rows long, is_unique boolean")
    found = empty
    for name in columns:
        values = df.select(F.col(f"`{name}`").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        total, present = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
        counted = values.agg(total.cast("long").alias("total_rows"), present.cast("long").alias("not_null_rows"), F.count("value").alias("distinct_rows"))
        one = counted.select(F.lit(name).alias("column_name"), "*").withColumn("is_unique", (F.col("total_rows") > 0) & (F.col("total_rows") == F.col("not_null_rows")) & (F.col("total_rows") == F.col("distinct_rows")))
        found = one if found is empty else found.unionByName(one)
    return found


def screen(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, int]]:
    """Rows, rows without null and estimated distinct values of each column.

    One scan folds all columns into mergeable sketches (HyperLogLog++): each task sends on
    one row, however large the table.
    """
    if not columns:
        return {}
    sketches = [x for i, c in enumerate(columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.approx_count_distinct(F.col(f"`{c}`"), SKETCH_ERROR).alias(f"d{i}"))]
    row = df.agg(F.count(F.lit(1)).alias("total"), *sketches).first()
    return {c: (row["total"], row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(columns)}


def may_be_unique(total: int, present: int, distinct: int) -> bool:
    """No for columns with nulls, or whose estimate is below the rows by more than the sketch could err."""
    return total > 0 and present == total and distinct >= total * (1 - SKETCH_DEVIATIONS * SKETCH_ERROR)


def is_unique(df: DataFrame, column: str) -> bool:
    """Exactly: no value of the column comes twice."""
    return df.groupBy(F.col(f"`{column}`")).count().where("count > 1").isEmpty()


def candidates(attributes: DataFrame, stats: DataFrame, limit: int = MAX_CANDIDATES, scan_without_stats: bool = False) -> DataFrame:
    """Columns worth an exact check, best first, per table.

    ``attributes``: schemaname, tablename, attname, typname, attnotnull, attnum,
    attisdropped.  Not-null columns come first, then those whose statistics say all
    values differ, then by distinct count and name.  Without statistics a column counts
    as having nulls and is skipped, unless ``scan_without_stats``.
    """
    live = attributes.where((F.col("attnum") > 0) & ~F.col("attisdropped") & F.col("typname").isin(*X.UNIQUE_TYPES))
    joined = live.join(stats, ["schemaname", "tablename", "attname"], "left")
    missing = F.lit(0.0) if scan_without_stats else F.lit(1.0)
    n = F.col("n_distinct")
    rank = F.when(n == -1, 1).when(n < 0, 2).when(n > 0, 3).otherwise(4)
    order = [F.desc("attnotnull"), rank, F.desc(F.abs(F.coalesce(n, F.lit(0.0)))), F.asc("attname")]
    placed = joined.withColumn("position", F.row_number().over(Window.partitionBy("schemaname", "tablename").orderBy(*order)).cast("long")).where(F.col("position") <= limit)
    return placed.withColumn("skipped", F.coalesce("null_frac", missing) > 0).select("schemaname", "tablename", "position", "attname", "typname", "skipped")


def find_unique_column(df: DataFrame, ordered: list[str]) -> dict | None:
    """The first column of ``ordered`` that is unique and has no null.

    Sketches of all columns in one scan leave few; these are checked exactly, in order, each
    in its own type, until one passes.  A column that is unique is never screened out but
    where its sketch errs by more than ``SKETCH_DEVIATIONS`` standard deviations.
    """
    types = dict(df.dtypes)
    for name, (total, present, distinct) in screen(df, ordered).items():
        if may_be_unique(total, present, distinct) and is_unique(df, name):
            return {"column": name, "total_rows": total, "distinct_rows": total, "type": types[name]}
    return None
