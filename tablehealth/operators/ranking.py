"""Positions in a total order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.sources.files import keep

_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the part


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1.

    Rows are sorted in ranges, each task numbers its own, and the numbers of rows in the
    tasks before are added: only one row for each task is ever summed in one place.
    """
    placed = keep(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1) + F.col("_before") + 1
    return placed.join(before, part == F.col("_part")).withColumn(name, place.cast("long")).drop("_place", "_part", "_before")
