"""Substring deduplication of words by seed and extend.

Seeds are winnowed word-grams: ``repeats`` joins documents on those that several hold, and
takes copies of a whole span at once.  Within a seed's bucket every match is extended both
ways, word by word and for all documents together: those that still agree stay in one
class, so that no pair of documents is ever made.  Matches that reach ``WINDOW`` words with
a document of a smaller doc_id count, and join to maximal repeats; the copy in the document
with the smallest doc_id stays.  Edge cases are those of ``repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, repeats

WINDOW = 50
SEED = 13


def _classes(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the different rows of ``columns``, all non-negative and below 2**31."""
    first, *others = columns
    for c in others:
        _, first = np.unique(first * (1 << 31) + c, return_inverse=True)
    return first


def extend(pool: repeats.Pool, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, window within it) of the windows that a smaller doc_id of the bucket holds too."""
    words = pool.spans.words()
    _, first = np.unique(words.hashes(0), return_inverse=True)
    _, second = np.unique(words.hashes(1), return_inverse=True)
    word = _classes(first, second)
    seed, left_words, right_words = words.offsets[:-1] + pool.anchor, pool.anchor, words.counts - pool.anchor
    spans, found = np.arange(len(pool.spans)), []

    def grown(classes: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Classes one word further on; -1 where the span ends."""
        out = np.full(len(classes), -1, np.int64)
        ok = (classes >= 0) & reach
        out[ok] = _classes(classes[ok], word[at[ok]])
        return out

    # right[r]: spans of a bucket that agree on r words from the seed's first on
    right = [_classes(pool.bucket)]
    for r in range(1, window + 1):
        right.append(grown(right[-1], seed + r - 1, right_words >= r))
    left = np.zeros(len(spans), np.int64)
    for before in range(int(left_words.max(initial=-1)) + 1):
        if before == window:
            break
        if before:
            left = grown(left, seed - before, left_words >= before)
        ok = np.flatnonzero((left >= 0) & (right[window - before] >= 0))
        if len(ok):
            match = _classes(right[window - before][ok], left[ok])
            lowest = np.full(match.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, match, pool.doc[ok])
            hit = ok[lowest[match] < pool.doc[ok]]
            found.append((hit, pool.anchor[hit] - before))
    owner, at = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return owner, at


RULE = repeats.Rule("word", WINDOW, SEED, repeats.SEEN_EARLIER, extend)


def _kept(text: str, starts: list[int], ends: list[int]) -> tuple[int, int, str]:
    words, kept, at, gone = text.encode().split(), [], 0, 0  # bytes.split() parts at exactly these separators
    for a, b in zip(starts, ends, strict=True):
        kept += words[at:a]
        at, gone = b, gone + b - a
    kept += words[at:]
    return len(words), gone, b" ".join(kept).decode()


def digest(docs: DataFrame, rule: repeats.Rule = RULE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, starts, ends: one row per row of ``docs``."""
    found = repeats.cuts(docs, rule)

    def rows(batch):
        out = {"n_words": [], "n_removed": [], "kept_sha256": []}
        for text, starts, ends in zip(batch["text"].to_pylist(), batch["_starts"].to_pylist(), batch["_ends"].to_pylist(), strict=True):
            n, gone, kept = _kept(text or "", starts or [], ends or [])
            for c, v in zip(out, (n, gone, hashlib.sha256(kept.encode()).hexdigest()), strict=True):
                out[c].append(v)
        yield out | {"doc_id": batch["doc_id"], "starts": batch["_starts"], "ends": batch["_ends"]}

    joined = repeats.attach(docs.select(*common.row_id(), F.col("doc_id").cast("long"), F.col("text").cast("string")), found)
    return common.arrow_map(joined.drop(*common.ROW), rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>")


def remove(docs: DataFrame, rule: repeats.Rule = RULE) -> DataFrame:
    """``docs`` with repeats taken out of text, n_chars to match; rows that were repeats throughout go.

    Rows without repeats stay as they are, white space included.
    """
    joined = repeats.attach(common.coded(docs), repeats.cuts(docs, rule))
    text, n_chars = (f"_column_{docs.columns.index(c)}" if c in docs.columns else None for c in ("text", "n_chars"))

    @F.pandas_udf("string")
    def kept(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_kept(t, list(a), list(b))[2] if a is not None and t is not None else t for t, a, b in zip(text, starts, ends, strict=True)])

    cut = F.col("_starts").isNotNull()
    joined = joined.withColumn("_text", F.when(cut, kept(text, "_starts", "_ends")).otherwise(F.col(text)))
    joined = joined.where(~cut | (F.col("_text") != "")).withColumn(text, F.col("_text"))
    if n_chars:
        joined = joined.withColumn(n_chars, F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return common.decoded(joined, docs)
