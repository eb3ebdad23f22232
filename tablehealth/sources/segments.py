"""Segment providers: which physical or logical shard a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_column(name: str) -> Column:
    return F.col(name)


def by_modulo(name: str, n: int) -> Column:
    return F.pmod(F.col(name), F.lit(n))


def by_hash(columns: list[str], n: int) -> Column:
    """The bucket that ``bucketBy(n, columns)`` would choose: the effect of a proposed key."""
    return F.pmod(F.hash(*columns), F.lit(n))


def by_partition() -> Column:
    return F.spark_partition_id()


def by_file() -> Column:
    """The file a row lies in; apply it to the relation itself."""
    return F.col("_metadata.file_path")


def by_bucket() -> Column:
    """The bucket of a bucketed table, read off its file names."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"_([0-9]+)[.]c", 1).cast("int")
