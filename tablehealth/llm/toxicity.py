"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are which of its words, pairs of neighbours and pairs one word apart
occur, hashed to ``2**BITS`` coordinates; case and ASCII punctuation do not matter.  The
fit takes a bounded sample of the labelled rows, ``SHARDS * SHARD_ROWS`` at most, chosen
by hash.  Each shard of the sample runs FTRL from the shared state for one round, the
states are averaged coordinate by coordinate, and the next round starts from there.
Per-coordinate rates and the L1 term leave few weights, which are broadcast: never more
than ``2**BITS`` of 12 bytes.

Scores use the text alone.  Rows whose crc32(doc_id) mod 5 is 0 are held out, rows
without a doc_id too.  Null and empty texts get the score of the bias; without labels the
score is 0.5 times nothing learned, that is 0.5 less the smallest step, so nothing is
predicted toxic.  A doc_id with several labels counts as toxic if any is 1; null labels
are no labels.  Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, scan

BITS = 20
SHARDS = 4
SHARD_ROWS = 4096
ROUNDS = 6
CHUNK = 1 << 16

ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(s: scan.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of a slice, and each one's document; repeats included."""
    words = s.lower().words(_APART)
    h = words.hashes()
    owner = np.searchsorted(words.offsets, np.arange(len(h)), "right") - 1
    grams, owners = [scan.mix(h)], [owner]
    for apart, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD1342543DE82EF95)):
        same = np.flatnonzero(owner[apart:] == owner[:-apart])
        grams.append(scan.mix(h[same] * np.uint64(salt) + h[same + apart]))
        owners.append(owner[same])
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def packed(coordinates: np.ndarray) -> bytes:
    """Ascending coordinates as steps, byte by byte: mostly zeros, which shuffles compress away."""
    return np.diff(coordinates, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of a state: zero wherever |z| is within the L1 term."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> None:
    """One pass over (coordinates, label) rows, in place; the last coordinate is the bias."""
    for at, label in rows:
        own, seen = z[at], n[at]
        w = weights(own, seen)
        # the bias is not shrunk by L1
        w[-1] = -own[-1] / ((BETA + np.sqrt(seen[-1])) / ALPHA + L2)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        step = (np.sqrt(seen + g * g) - np.sqrt(seen)) / ALPHA
        z[at] = own + g - step * w
        n[at] = seen + g * g


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """shard, order, label, features: the labelled rows that the fit takes (staged)."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    known = marked.count()
    share = min(1.0, SHARDS * SHARD_ROWS / max(known, 1))
    shards = min(SHARDS, max(1, -(-known // SHARD_ROWS)))
    order = F.xxhash64("doc_id")
    chosen = marked.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col("doc_id").alias("_doc"), (F.col("toxic") > 0).cast("int").alias("label"), F.pmod(F.shiftright(order, 20), F.lit(shards)).cast("int").alias("shard"))
    chosen = common.small(common.stage(chosen, "labelled"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, F.col("doc_id") == F.col("_doc")).select("shard", "label", "doc_id", "text")

    def rows(batch):
        for s in scan.slices(batch["text"]):
            at, owner = features(s)
            key = np.unique(owner << BITS | at)
            yield {c: batch[c].slice(s.first, len(s)) for c in ("shard", "label", "doc_id")} | {"features": [packed(x) for x in np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, len(s))))]}

    return common.stage(common.arrow_map(texts, rows, "shard int, label int, doc_id long, features binary"), "features")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias of the model."""
    spark, taken = docs.sparkSession, sample(docs, labels)
    z, n = np.zeros((1 << BITS) + 1, np.float32), np.zeros((1 << BITS) + 1, np.float32)

    def shard(state, number: int):
        def run(table: pa.Table) -> pa.Table:
            own_z, own_n = (x.astype(np.float64) for x in state.value)
            table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("features", "ascending")])  # rows of one id too stand in an order of their own
            rows = [(np.append(unpacked(x), 1 << BITS), y) for x, y in zip(table["features"].to_pylist(), table["label"].to_pylist(), strict=True)]
            order = np.random.Generator(np.random.PCG64(number)).permutation(len(rows))
            train(own_z, own_n, [rows[i] for i in order])
            starts = range(0, len(own_z), CHUNK)
            return pa.table({"chunk": pa.array(range(len(starts)), pa.int32()), "z": pa.array([own_z[i : i + CHUNK].astype(np.float32).tobytes() for i in starts], pa.binary()), "n": pa.array([own_n[i : i + CHUNK].astype(np.float32).tobytes() for i in starts], pa.binary())})

        return run

    def average(table: pa.Table) -> pa.Table:
        mean = {c: np.mean([np.frombuffer(x, np.float32) for x in table[c].to_pylist()], axis=0, dtype=np.float64) for c in ("z", "n")}
        return pa.table({"chunk": table["chunk"].slice(0, 1)} | {c: pa.array([x.astype(np.float32).tobytes()], pa.binary()) for c, x in mean.items()})

    kinds = "chunk int, z binary, n binary"
    for number in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))  # 8 bytes for each of 2**BITS coordinates
        found = taken.groupBy("shard").applyInArrow(shard(state, number), kinds).groupBy("chunk").applyInArrow(average, kinds).collect()
        if not found:
            break
        found.sort(key=lambda r: r["chunk"])
        z, n = (np.frombuffer(b"".join(r[c] for r in found), np.float32) for c in ("z", "n"))
        state.unpersist()
    w = weights(z[:-1].astype(np.float64), n[:-1])
    at = np.flatnonzero(w)
    return at, w[at], float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    at, w, bias = model
    held = docs.sparkSession.sparkContext.broadcast((at, w.astype(np.float32)))
    bias = bias or -1e-9  # nothing learned predicts nothing

    def rows(batch):
        table = np.zeros(1 << BITS, np.float32)
        table[held.value[0]] = held.value[1]
        for s in scan.slices(batch["text"]):
            found, owner = features(s)
            hit = np.flatnonzero(table[found])
            key = np.unique(owner[hit] << BITS | found[hit])
            total = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)].astype(np.float64), len(s)) + bias
            yield {"doc_id": batch["doc_id"].slice(s.first, len(s)), "score": 1 / (1 + np.exp(-np.clip(total, -500, 500)))}

    scored = common.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
