"""Whitening of embeddings: blockwise QR of centred rows, then a bidiagonal qd solver.

``fit`` takes one pass.  Every task folds its rows, block by block and centred on the
block's own mean, into one triangular factor R; factors of tasks are merged in groups of
``FAN`` with a row for each mean's distance from the common one, so that the last factor
is R of all centred rows, whatever their number.  Its singular values and right vectors
(``bidiagonal``) are the deviations and directions of the covariance.  ``whiten`` then
projects every row, and one more pass measures how far the result is from white.

Entries become whole numbers, x = floor(1024 * entry) + 100000, within 2**45; sums are
exact.  Vectors that are null or empty, hold null or non-finite entries, or have another
length than most vectors (of equally frequent lengths, the shorter) take no part.
Repeated rows and null ids count and come out row by row; other columns are not looked
at.  A component without variance (above what rounding leaves) has null in ``whitened``
and counts as no part of ``identity_error``, which is null where no component is left;
``explained`` is null where nothing varies at all.  ``deviation`` is null where it does
not fit in a long.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import bidiagonal, common

#: Fixed by the contract.
UNITS = 1024
OFFSET = 100_000
COMPONENTS = 8

BLOCK_ROWS = 4096
#: Partial factors that one task merges: FAN triangles of dimension squared doubles.
FAN = 32
_LIMIT = float(1 << 45)

_FACTOR = "block long, n long, sums array<string>, factor binary"
_FIT = "component int, n long, sums array<string>, total double, value double, direction binary"
_MOMENTS = "block long, n long, mean binary, moments binary"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, all of one length."""
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = narrow.where((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = finite.groupBy(F.size("embedding").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), "d").select("d").limit(1).collect()
    return finite.where(F.size("embedding") == (most[0]["d"] if most else 0))


def whole(batch) -> np.ndarray:
    """The vectors of a batch as whole numbers, a row each."""
    flat = batch["embedding"].flatten().to_numpy(zero_copy_only=False)
    x = np.clip(np.floor(flat * UNITS), -_LIMIT, _LIMIT).astype(np.int64) + OFFSET
    return x.reshape(batch.num_rows, -1)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of ``rows``, square."""
    r, d = np.linalg.qr(rows, mode="r"), rows.shape[1]
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def merged(parts: list[tuple[int, list[int], np.ndarray]]) -> tuple[int, list[int], np.ndarray]:
    """Rows, exact sums and R of several sets of rows, each centred on its own mean, as one set."""
    n = sum(p[0] for p in parts)
    sums = [sum(x) for x in zip(*(p[1] for p in parts), strict=True)]
    between = [np.sqrt(m) * np.array([(n * s - m * t) / (m * n) for s, t in zip(own, sums, strict=True)]) for m, own, _ in parts]
    return n, sums, triangle(np.vstack([*between, *(p[2] for p in parts)]))


def _block(x: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    n, sums = len(x), x.sum(axis=0)
    return n, sums.tolist(), triangle((n * x - sums) / n)


def _row(block: int, n: int, sums: list[int], r: np.ndarray) -> dict:
    return {"block": [block], "n": [n], "sums": [[str(s) for s in sums]], "factor": [np.ascontiguousarray(r).tobytes()]}


def _parts(rows) -> list[tuple[int, list[int], np.ndarray]]:
    return [(int(r.n), [int(s) for s in r.sums], np.frombuffer(r.factor).reshape(len(r.sums), -1)) for r in rows.itertuples()]


def factors(vectors: DataFrame) -> DataFrame:
    """One row for each task with rows: count, sums and R."""

    def fold(batches):
        held, done = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(whole(batch))
            if sum(map(len, held)) >= BLOCK_ROWS:
                done, held = merged(([done] if done else []) + [_block(np.vstack(held))]), []
        if held:
            done = merged(([done] if done else []) + [_block(np.vstack(held))])
        if done:
            yield _one(_row(TaskContext.get().partitionId(), *done))

    common.short_batches(vectors.sparkSession)
    return vectors.mapInArrow(fold, _FACTOR)


def tree(parts: DataFrame, merge, schema: str) -> DataFrame:
    """Merge the numbered rows in groups of ``FAN`` neighbours until one is left; each level is a shuffle of these rows alone."""
    last = parts.agg(F.max("block")).first()[0]
    width = 0 if last is None else last + 1
    while width > 1:
        parts = parts.groupBy(F.floor(F.col("block") / FAN).alias("block")).applyInPandas(merge, schema)
        width = -(-width // FAN)
    return parts


def fit(vectors: DataFrame, components: int = COMPONENTS) -> list[dict]:
    """n, exact sums, variance of all and the leading components of ``usable`` vectors; empty without rows.

    What reaches the driver is ``components`` vectors, however many rows there are.
    """

    def merge(key, rows):
        import pandas as pd

        return pd.DataFrame(_row(key[0], *merged(_parts(rows))))

    def solve(frames):
        import pandas as pd

        for frame in frames:
            for n, sums, r in _parts(frame):
                values, directions = bidiagonal.singular(r, components)
                total = float((r * r).sum()) / n
                values[values <= max(r.shape) * bidiagonal.EPS * values[:1].max(initial=0.0)] = 0.0
                m = len(values)
                yield pd.DataFrame({"component": np.arange(1, m + 1, dtype=np.int32), "n": [n] * m, "sums": [[str(s) for s in sums]] * m, "total": [total] * m, "value": values * values / n, "direction": [v.tobytes() for v in directions]})

    blocks = common.stage(factors(vectors), "factors")
    found = tree(blocks, merge, _FACTOR).mapInPandas(solve, _FIT).collect()
    return sorted(({**r.asDict(), "sums": [int(s) for s in r["sums"]], "direction": np.frombuffer(bytes(r["direction"]))} for r in found), key=lambda r: r["component"])


class Projection:
    """Takes whole vectors to their deviations and whitened coordinates."""

    def __init__(self, found: list[dict]):
        self.n, self.total = found[0]["n"], found[0]["total"]
        sums = found[0]["sums"]
        self.floor = np.array([s // self.n for s in sums], np.int64)  # the mean's whole part
        self.rest = np.array([s % self.n for s in sums], np.int64)
        self.values = np.array([r["value"] for r in found])
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1.0)), np.nan)
        self.matrix = np.array([r["direction"] for r in found]).T * scale
        self.explained = self.values / self.total if self.total > 0 else np.full(len(found), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.floor).astype(np.float64) - self.rest / self.n) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum) squared, exact; none where a long is too short."""
        near = x - self.floor
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if x.shape[1] * most * most < 1 << 63:
            return ((self.n * near - self.rest) ** 2).sum(axis=1).tolist()
        rest = self.rest.tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _moments(projection: Projection):
    """mapInArrow function: count, mean and centred products of whitened rows, one row for each task."""

    def fold(batches):
        done = None
        for batch in batches:
            if batch.num_rows:
                w = projection.whitened(whole(batch))
                mean = w.mean(axis=0)
                own = (len(w), mean, (w - mean).T @ (w - mean))
                done = own if done is None else _joined([done, own])
        if done:
            yield _one({"block": [TaskContext.get().partitionId()], "n": [done[0]], "mean": [done[1].tobytes()], "moments": [done[2].tobytes()]})

    return fold


def _joined(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n = sum(p[0] for p in parts)
    mean = sum(m * own for m, own, _ in parts) / n
    return n, mean, sum(c + m * np.outer(own - mean, own - mean) for m, own, c in parts)


def identity_error(vectors: DataFrame, projection: Projection) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""

    def merge(key, rows):
        import pandas as pd

        n, mean, moments = _joined([(int(r.n), np.frombuffer(r.mean), np.frombuffer(r.moments).reshape(k, k)) for r in rows.itertuples()])
        return pd.DataFrame({"block": [key[0]], "n": [n], "mean": [mean.tobytes()], "moments": [moments.tobytes()]})

    k = len(projection.values)
    blocks = common.stage(vectors.mapInArrow(_moments(projection), _MOMENTS), "moments")
    last = tree(blocks, merge, _MOMENTS).first()
    varied = projection.values > 0
    if last is None or not varied.any():
        return None
    covariance = np.frombuffer(bytes(last["moments"])).reshape(k, k) / last["n"]
    return float(np.abs(covariance[np.ix_(varied, varied)] - np.eye(int(varied.sum()))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    with common.scratch(vectors.sparkSession):
        used = usable(vectors)
        found = fit(used, components)
        if not found:
            return vectors.sparkSession.createDataFrame([], f"{_OUT}, identity_error double")
        projection = Projection(found)
        error = identity_error(used, projection)
    k = len(found)

    def rows(batch):
        x = whole(batch)
        w, m = projection.whitened(x), len(x)
        ids = batch["vec_id"].take(np.repeat(np.arange(m), k))
        flat = {"whitened": w.ravel(), "explained": np.tile(projection.explained, m)}
        yield {
            "vec_id": ids,
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
            "n": np.full(m * k, projection.n),
            "deviation": [v for v in projection.deviations(x) for _ in range(k)],
        } | {name: _nullable(values) for name, values in flat.items()}

    return common.arrow_map(used, rows, _OUT).withColumn("identity_error", F.lit(error).cast("double"))


def _one(columns: dict) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.binary())) for n, v in columns.items()], names=list(columns))


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))
