"""Deduplication of repeated byte strings by bucket-pointer refinement.

``repeats`` finds the places worth sorting: initial buckets of equal q-grams at winnowed
positions, buckets of one dropped, copies of a span taken once.  Within a bucket the
positions of all spans are sorted as a suffix array is by bucket pointers: they start in
buckets by their first eight bytes, and a round sorts the bucket identifiers of each
position together with that of the position as far on as the bucket is deep.  So every
round doubles the depth with the identifiers of the last, and no text is looked at again;
positions that are alone in their bucket leave, and with them all that would point at them.
At depth ``WINDOW`` a bucket holds equal strings.  Every byte within a string that starts
anywhere else goes.  Edge cases are those of ``repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, repeats, scan

WINDOW = 200
GRAM = 64
#: Bytes of the initial buckets.
FIRST_DEPTH = 8


def refine(pool: repeats.Pool, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, window within it) of the windows that start at two positions or more."""
    data, offsets = pool.spans.data, pool.spans.offsets
    n, depth = len(data), min(FIRST_DEPTH, window)
    blocks = np.ndarray(n + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = np.flatnonzero(scan.whole_windows(offsets, depth, n))
    _, bucket = np.unique(blocks[at] & np.uint64((1 << 8 * depth) - 1), return_inverse=True)
    pointers = np.full(n + window, -1, np.int64)
    while True:
        several = np.bincount(bucket)[bucket] > 1 if len(bucket) else np.zeros(0, bool)
        pointers[:] = -1
        at = at[several]
        pointers[at] = bucket[several]
        if depth == window:
            break
        step = min(depth, window - depth)
        whole = scan.whole_windows(offsets, depth + step, n)
        at = at[at < len(whole)]
        at = at[whole[at] & (pointers[at + step] >= 0)]
        _, bucket = np.unique(pointers[at] * (n + 1) + pointers[at + step], return_inverse=True)
        depth += step
    owner = np.searchsorted(offsets, at, "right") - 1
    return owner, at - offsets[owner]


RULE = repeats.Rule("byte", WINDOW, GRAM, repeats.SEEN_ELSEWHERE, refine)


def digest(docs: DataFrame, rule: repeats.Rule = RULE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends: one row per row of ``docs``."""
    found = repeats.cuts(docs, rule)

    def rows(batch):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, starts, ends in zip(batch["text"], batch["_starts"].to_pylist(), batch["_ends"].to_pylist(), strict=True):
            raw = memoryview(text.as_buffer() if text.is_valid else b"")
            kept, at, gone = hashlib.sha256(), 0, 0
            for a, b in zip(starts or (), ends or (), strict=True):
                kept.update(raw[at:a])
                at, gone = b, gone + b - a
            kept.update(raw[at:])
            for c, v in zip(out, (len(raw), gone, len(starts or ()), kept.hexdigest()), strict=True):
                out[c].append(v)
        yield out | {"doc_id": batch["doc_id"], "starts": batch["_starts"], "ends": batch["_ends"]}

    joined = repeats.attach(docs.select(*common.row_id(), F.col("doc_id").cast("long"), F.col("text").cast("string")), found)
    return common.arrow_map(joined.drop(*common.ROW), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
