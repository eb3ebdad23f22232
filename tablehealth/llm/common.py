"""Helpers shared by the training-data operators: staging, size-checked joins, Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast, by its counted rows, up to the session's
#: ``spark.sql.autoBroadcastJoinThreshold`` and never beyond this; else it is shuffled.
BROADCAST_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset another one takes its place: on one machine a temporary
    folder, removed at the end, and on a cluster one in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="stages-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


_SCRATCH = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables staged within are deleted at the end; those staged with ``keep`` go with the scratch around this one, if there is one."""
    levels = _SCRATCH.levels = [*getattr(_SCRATCH, "levels", []), []]
    try:
        yield
    finally:
        _SCRATCH.levels = levels[:-1]
        for path in levels[-1]:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    levels = getattr(_SCRATCH, "levels", [])[: -1 if keep else None]
    if levels:
        levels[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> int:
    """What a row takes in a broadcast table, hash table included; strings are taken for short names."""
    width = {"string": 64, "binary": 64}
    return 64 + sum(width.get(kind, 8 if "<" not in kind else 64) for _, kind in df.dtypes)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which a side is broadcast: the session's own threshold, within ``BROADCAST_BYTES``."""
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return min(BROADCAST_BYTES, max(0, threshold))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a staged frame for broadcast if its counted rows prove it small; else leave the join to shuffle."""
    return F.broadcast(df) if fits(df, limit) else df


def fits(df: DataFrame, limit: int | None = None) -> bool:
    return df.count() * row_bytes(df) <= (broadcast_limit(df.sparkSession) if limit is None else limit)


#: What the bitmap of ``thin`` takes at most.
FILTER_BYTES = 16 << 20


def thin(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df`` without most of the rows that have no partner in the staged ``keys``: a shuffled join then moves few rows in vain.

    A broadcast bitmap of 32 bits or more a key, up to ``FILTER_BYTES``, never leaves out a
    row with a partner.  Keys so many that they would fill half of it go without one.
    """
    return parted(df, keys, on)[0]


def parted(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``df`` as the rows that ``thin`` leaves and those that surely have no partner; none of the latter without a bitmap."""
    many = keys.count()
    bits = 1 << min(max(15, (32 * many).bit_length()), (8 * FILTER_BYTES).bit_length() - 1)
    if 2 * many > bits:
        return df, None
    bit = F.xxhash64(*on).bitwiseAND(bits - 1)
    page, place = F.floor(bit / (1 << 15)), bit.bitwiseAND((1 << 15) - 1)
    dealt = keys.select(page.alias("_page"), place.alias("_place")).repartition("_page")
    bitmaps = dealt.groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    hit = (page == F.col("_page")) & (F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1)
    return df.join(F.broadcast(bitmaps), hit, "left_semi"), df.join(F.broadcast(bitmaps), hit, "left_anti")


#: In the place of a null doc_id: larger than any other.
LAST_ID = (1 << 63) - 1


def row_key() -> F.Column:
    """Hash of a row's id and text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def row_id() -> list[F.Column]:
    """Identity of a row by content, _doc and _key: repeated rows share it, so they share every decision.

    The id beside the hash: only rows of one doc_id could ever be mistaken for each other.
    """
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_doc"), row_key().alias("_key")]


ROW = ["_doc", "_key"]


def coded(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by position, so that none clashes, and its ``row_id``."""
    return docs.select(*row_id(), *[F.col(f"`{c}`").alias(f"_column_{i}") for i, c in enumerate(docs.columns)])


def decoded(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return frame.select(*[F.col(f"_column_{i}").alias(c) for i, c in enumerate(docs.columns)])


def short_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python: a thousand at a time, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def give_back() -> None:
    """Freed memory of this worker to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, tokens: bool = False) -> DataFrame:
    """mapInArrow over ``df``; ``function`` yields column dicts for each incoming batch.

    Workers are reused: work without ``tokens`` drops what tokenizers have cached, and
    each task gives freed memory back.
    """
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    short_batches(df.sparkSession)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)
        if not tokens and (encode := sys.modules.get("tablehealth.llm.encode")):
            encode.forget()
        try:
            for batch in batches:
                if batch.num_rows:
                    for columns in function(batch):
                        yield pa.RecordBatch.from_arrays([cast(columns[f.name], f.type) for f in target], schema=target)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def cast(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray):
        if values.dtype == np.uint64:
            values = values.view(np.int64)
        values = pa.array(values)
    elif not isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = pa.array(values, kind)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if values.type == kind else values.cast(kind)
