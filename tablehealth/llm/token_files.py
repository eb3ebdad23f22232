"""Token ids in fixed-width bit-packed files, written in ascending doc_id order.

Format: a Parquet folder of blocks, one row each.  A block holds whole documents, about
``BLOCK_IDS`` ids (a longer document is a block of its own):

    shard, block   the writing task, and the block's number within it
    base           ids of the shard before this block
    bits           width of an id: the fewest bits that hold the vocabulary
    doc_ids        the documents, in order
    offsets        first id of each document within the block, then the block's id count
    payload        all ids, ``bits`` wide, least significant bit first, no padding between

Shards follow one another in doc_id order.  Because ids have one width, any id sits at a
known bit, a block unpacks with numpy in one go, and ``read_documents`` opens only the
blocks whose doc_id range matches (Parquet statistics on first_doc and last_doc).

Null and empty texts have the end id alone.  Null doc_ids sort first; equal doc_ids are
all kept, ordered by text.  Extra columns are not read; an empty table writes no block.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehealth.llm import common, encode

END_ID = 2
BLOCK_IDS = 1 << 16
RANGE_CHARS = 256  # of the text, for ranges within one doc_id: sampled to the driver
BLOCKS = "shard int, block int, base long, bits int, n_ids long, first_doc long, last_doc long, doc_ids array<long>, offsets array<long>, payload binary"


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one little-endian bit stream, ``bits`` each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from the ``start``-th on, touching only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, -(-(start + n) * bits // 8)
    stream = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    own = np.zeros((n, 32), np.uint8)
    skip = start * bits - low * 8
    own[:, :bits] = stream[skip : skip + n * bits].reshape(n, bits)
    return np.packbits(own, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def write(docs: DataFrame, path: str, vocabulary_file: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id``, and write the blocks under ``path``.

    Texts are range-partitioned by doc_id and, as an id may stand for many rows, by how they
    begin, before they are encoded: one shuffle of the raw
    text, after which encoding, packing and writing happen in one stage, batch by batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(BLOCKS)

    def run(batches):
        from pyspark import TaskContext

        encoder, target = encode.encoder(vocabulary_file), to_arrow_schema(kinds)
        bits = max(width(encoder.vocabulary), width(end_id + 1))
        shard, state = TaskContext.get().partitionId(), {"block": 0, "base": 0}

        def block(doc_ids, counts, ids):
            total = int(counts.sum())
            known = [x for x in doc_ids if x is not None]
            row = {"shard": shard, "bits": bits, "n_ids": total, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "doc_ids": doc_ids, "offsets": [0, *np.cumsum(counts).tolist()], "payload": pack(ids, bits)} | state
            state["block"] += 1
            state["base"] += total
            return pa.RecordBatch.from_pylist([row], schema=target)

        doc_ids, counts, ids, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got, lengths = encoder.encode_many(part["text"].to_pylist())
                ends = np.cumsum(lengths)
                with_end = np.insert(got, ends, end_id)
                lengths, ends, own = lengths + 1, np.cumsum(lengths + 1), part["doc_id"].to_pylist()
                begin = 0
                while begin < len(own):
                    # as many documents as fill the open block, one at least
                    before = int(ends[begin - 1]) if begin else 0
                    to = max(begin + 1, int(np.searchsorted(ends, before + block_ids - held, "right")))
                    if held and int(ends[begin]) - before + held > block_ids:
                        yield block(doc_ids, np.concatenate(counts), np.concatenate(ids))
                        doc_ids, counts, ids, held = [], [], [], 0
                        continue
                    doc_ids += own[begin:to]
                    counts.append(lengths[begin:to])
                    ids.append(with_end[before : int(ends[to - 1])])
                    held += int(ends[to - 1]) - before
                    begin = to
        if doc_ids:
            yield block(doc_ids, np.concatenate(counts), np.concatenate(ids))

    common.short_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, kinds).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document out of the files: doc_id, start, n_tokens, ids_crc32, shard, block.

    Only the shards' totals are summed across tasks; a block knows its place in its shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def rows(batch):
        for row in batch.to_pylist():
            at = np.array(row["offsets"], np.int64)
            ids = unpack(row["payload"], row["bits"], 0, int(at[-1])).astype("<u4").tobytes()
            crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = len(crc)
            yield {"doc_id": row["doc_ids"], "within": at[:-1] + row["base"], "n_tokens": np.diff(at), "ids_crc32": crc, "shard": np.full(n, row["shard"], np.int32), "block": np.full(n, row["block"], np.int32)}

    found = common.arrow_map(blocks.select("shard", "block", "base", "bits", "doc_ids", "offsets", "payload"), rows, "doc_id long, within long, n_tokens long, ids_crc32 long, shard int, block int")
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy(F.col("shard").alias("_shard")).agg(F.sum("n_ids").alias("n")).select("_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    shards = common.stage(shards, "shards")
    return found.join(common.small(shards), F.col("shard") == F.col("_shard")).select("doc_id", (F.col("_before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """doc_id and ids of the documents with low <= doc_id <= high, out of their blocks alone."""
    blocks = spark.read.schema(BLOCKS).parquet(path).where((F.col("last_doc") >= low) & (F.col("first_doc") <= high))

    def rows(batch):
        for row in batch.to_pylist():
            at = row["offsets"]
            own = [(d, unpack(row["payload"], row["bits"], at[i], at[i + 1] - at[i]).tolist()) for i, d in enumerate(row["doc_ids"]) if d is not None and low <= d <= high]
            yield {"doc_id": [d for d, _ in own], "ids": [x for _, x in own]}

    return common.arrow_map(blocks.select("bits", "doc_ids", "offsets", "payload"), rows, "doc_id long, ids array<long>")


def write_and_read(docs: DataFrame, vocabulary_file: str, path: str | None = None) -> DataFrame:
    """``write`` to a folder, by default one in the shared folder, then ``read`` it."""
    spark = docs.sparkSession
    path = path or f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, vocabulary_file)
    return read(spark, path)
