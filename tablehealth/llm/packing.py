"""Best-fit packing of documents into sequences of bounded length.

Texts become pieces where they are read; only piece lengths are shuffled.  Pieces are
numbered as they are written, dealt by number over groups of about ``GROUP_PIECES``, and
each group is packed online, in the order of the numbers, with a fixed number of open
bins: a bitset keyed by free space finds the tightest bin that still fits, and when one
bin too many is open, the fullest closes.  A group is bounded whatever the input, repeated
rows included, so more data means more groups.

A piece as long as a sequence is one by itself.  Null and empty texts are one piece with
the end id alone; repeated rows are packed as often as they occur; extra columns are not
read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, encode

SEQUENCE_TOKENS = 1024
END_ID = 2
GROUP_PIECES = 1 << 16
OPEN_BINS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, most: int) -> np.ndarray:
    """Piece lengths of n tokens: whole sequences, before them the rest."""
    return np.array([n % most] * bool(n % most) + [most] * (n // most), np.int64)


def pieces(docs: DataFrame, vocabulary_file: str, most: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it starts in its document, its length and the checksum of its ids."""

    def rows(batch):
        encoder = encode.encoder(vocabulary_file)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, counts = encoder.encode_many(part["text"].to_pylist())
            raw = memoryview(np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes())
            lengths = [cut(int(n), most) for n in counts + 1]
            many = np.array([len(x) for x in lengths])
            length = np.concatenate(lengths)
            end = np.cumsum(length)
            owner = np.repeat(np.arange(part.num_rows), many)
            opens = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
            yield {
                "doc_id": part["doc_id"].take(pa.array(owner)),
                "piece": (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32),
                "start": end - length - opens[owner],
                "length": length,
                "ids_crc32": [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(end.tolist(), length.tolist(), strict=True)],
            }

    return common.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, PIECES, tokens=True)


def best_fit(lengths: list[int], most: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, online in the given order."""
    free_set, by_free = 0, {}  # bit f: some open bin has f free; the open bins by free space
    bins, offsets, opened, count = [], [], 0, 0
    for n in lengths:
        fits = free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            own = by_free[free]
            bin_ = own.pop()
            if not own:
                free_set ^= 1 << free
        else:
            bin_, free, opened, count = opened, most, opened + 1, count + 1
        bins.append(bin_)
        offsets.append(most - free)
        free -= n
        if free == 0:
            count -= 1
            continue
        by_free.setdefault(free, []).append(bin_)
        free_set |= 1 << free
        if count > open_bins:
            fullest = (free_set & -free_set).bit_length() - 1
            own = by_free[fullest]
            own.pop(0)
            if not own:
                free_set ^= 1 << fullest
            count -= 1
    return bins, offsets


def pack(cut_pieces: DataFrame, most: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Sequence and offset of every piece (a staged frame with _number: it is counted first)."""
    groups = max(1, round(cut_pieces.count() / group_pieces))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_number")
        bins, offsets = best_fit(table["length"].to_pylist(), most, open_bins)
        group = table["_group"][0].as_py()
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(np.array(bins, np.int64) + (group << 32))).append_column("offset", pa.array(offsets, pa.int64()))

    grouped = cut_pieces.withColumn("_group", F.pmod(F.xxhash64("_number"), F.lit(groups)))
    return grouped.groupBy("_group").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, vocabulary_file: str, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """The sequences of ``docs``; edge cases are those of the module."""
    with common.scratch(docs.sparkSession):
        # the number is staged with the piece, so that it holds from here on
        numbered = common.stage(pieces(docs, vocabulary_file, most).withColumn("_number", F.monotonically_increasing_id()), "pieces")
        return common.stage(pack(numbered, most), "packed", keep=True)
