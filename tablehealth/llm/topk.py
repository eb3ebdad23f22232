"""Exact top-k inner products by KD-trees, one per shard.

Vectors are dealt over shards of bounded size by place: median splits over a bounded sample
give planes, and a place that holds more than a shard, as one of many copies does, is dealt
on by row.  A shard's tree is built by median splits on the widest dimension, every node
with a tight bounding box and its smallest id.  For a query, the largest inner product that
a box allows is sum(max(q * low, q * high)); nodes are visited best bound first, and a node
is passed over when its bound is below the k-th score so far, or equal to it with only
larger ids.  Shards are visited in the same way: each query goes first to the shard whose
box allows the most, and with the k-th score found there on to the others.  Queries of
like home shards form parts, a part meets the shards that any of its queries can reach, and
a task takes a part through a group of these shards, the most promising first, while the
k-th scores it has so far rule out what is left.

What is stored is one row for each vector, query, and pair of a part and a shard: a query's
vector goes to groups of shards in packed blocks, and no pair of a query and a shard, or of
two rows, is ever a row.  Vectors that are null or empty or hold null or non-finite components take no
part; vectors are compared with those of their own length; equal scores go to the smaller
id; repeated ids are all kept, and none is compared with rows of its own id.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.llm import common

SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERY_BLOCK = 256
#: Queries of a part, or of a block of boxes, in one task.
TASK_QUERIES = 1 << 15
#: Shards that a task takes a part through at most, on average.
TASK_SHARDS = 16
#: Tasks of a search at most.
MOST_TASKS = 20_000
#: Boxes that a query is held against at a time.
BOX_BLOCK = 1 << 14
#: Vectors that the planes are drawn from, and the values they have together at most.
SAMPLE_ROWS, SAMPLE_VALUES = 1 << 13, 1 << 21
SCALE = 256
#: A score below any other.
NO_FLOOR = -(1 << 62)
FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Median-split tree over integer vectors with tight boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.least, self.children, self.rows = [], [], [], [], []
        stack = [(np.arange(len(ids)), None, 0)]
        while stack:
            rows, parent, side = stack.pop()
            node, own = len(self.rows), self.vectors[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(self.ids[rows].min()))
            self.children.append([-1, -1])
            self.rows.append(rows)
            if parent is not None:
                self.children[parent][side] = node
            widest = int((high - low).argmax())
            if len(rows) > leaf_rows and high[widest] > low[widest]:
                middle = np.argsort(own[:, widest], kind="stable")
                half = len(rows) // 2
                stack += [(np.sort(rows[middle[half:]]), node, 1), (np.sort(rows[middle[:half]]), node, 0)]
                self.rows[node] = None
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with anything in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id), rows of the query's own id left out, given that k scores of at least ``floor`` exist elsewhere."""
        best: list[tuple] = []  # a heap of (score, -id): its first is the k-th so far
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            bound = -bound
            if bound < floor or len(best) == k and bound < best[0][0]:
                break
            if len(best) == k and bound == best[0][0] and self.least[node] > -best[0][1]:
                continue
            rows = self.rows[node]
            if rows is None:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(nodes, (-bounds[child], child))
                continue
            scores = self.vectors[rows] @ query
            worth = np.flatnonzero(scores >= (max(floor, best[0][0]) if len(best) == k else floor))
            worth = worth[self.ids[rows[worth]] != query_id]  # all of the query's own, before any is cut off
            if len(worth) > 2 * k:  # rows are in id order: a stable sort keeps the smaller ids
                worth = worth[np.argsort(-scores[worth], kind="stable")[:k]]
            for i in worth.tolist():
                found = (scores[i].item(), -int(self.ids[rows[i]]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return [(int(s), -i) for s, i in best]


def vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, _vector (longs: floor(scale * component)), _length of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    integers = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound).select(F.col("vec_id").cast("long"), integers.alias("_vector"), F.size("embedding").alias("_length"))


def _matrix(column) -> np.ndarray:
    """Rows of a list column; doubles where all products are exact in them, else longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    most = int(np.abs(flat).max(initial=0))
    return flat.astype(np.float64) if most * most * flat.shape[1] < 2**53 else flat


def planes(sample: list[np.ndarray], leaves: int) -> list[tuple]:
    """Median splits on the widest dimension, as (dimension, bound, node below, node from it on); a leaf is (number,)."""
    nodes, stack, done = [None], [(0, np.array(sample), leaves)], 0
    while stack:
        at, rows, many = stack.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        widest = int((high - low).argmax())
        bound = np.sort(rows[:, widest])[len(rows) // 2] if len(rows) else 0
        below = rows[rows[:, widest] < bound] if len(rows) else rows
        if many < 2 or not len(below):
            nodes[at] = (done,)
            done += 1
            continue
        nodes[at] = (widest, bound.item(), len(nodes), len(nodes) + 1)
        nodes += [None, None]
        stack += [(nodes[at][2], below, many // 2), (nodes[at][3], rows[rows[:, widest] >= bound], many - many // 2)]
    return nodes


def deal(every_vector: DataFrame, n: int) -> DataFrame:
    """_shard of each row, of about ``SHARD_ROWS`` rows: by its place, then by row number where a place holds more."""
    longest = every_vector.agg(F.max("_length")).first()[0] or 1
    most = max(64, min(SAMPLE_ROWS, SAMPLE_VALUES // longest))
    sample = every_vector.orderBy(F.xxhash64("_row")).limit(most).select("_length", "_vector").collect()
    lengths: dict[int, list] = {}
    for r in sample:
        lengths.setdefault(r["_length"], []).append(r["_vector"])
    leaves = max(1, -(-n // SHARD_ROWS))
    trees = {k: planes(v, max(1, min(len(v) // 2, leaves * len(v) // len(sample)))) for k, v in lengths.items()}

    def places(batch):
        lengths_, leaf = batch["_length"].to_numpy(), np.zeros(batch.num_rows, np.int64)
        for k in np.unique(lengths_).tolist():
            rows = np.flatnonzero(lengths_ == k)
            stack = [(0, rows, batch["_vector"].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), k))]
            while stack and k in trees:
                at, own, values = stack.pop()
                if len(trees[k][at]) == 1:
                    leaf[own] = trees[k][at][0]
                    continue
                dimension, bound, below, above = trees[k][at]
                left = values[:, dimension] < bound
                stack += [(below, own[left], values[left]), (above, own[~left], values[~left])]
        yield {c: batch[c] for c in ("_row", "vec_id", "_vector", "_length")} | {"_leaf": leaf}

    # a length is a place of its own: leaves are numbered within it
    placed = common.stage(common.arrow_map(every_vector.select("_row", "vec_id", "_vector", "_length"), places, "_row long, vec_id long, _vector array<long>, _length int, _leaf long"), "places")
    found = placed.groupBy("_length", "_leaf").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.expr(f"(_n + {SHARD_ROWS - 1}) div {SHARD_ROWS}"))
    found = common.small(common.stage(found.select("_length", "_leaf", "_parts"), "leaves"))
    part = F.pmod(F.xxhash64("_row"), F.col("_parts"))
    return placed.join(found, ["_length", "_leaf"]).withColumn("_shard", F.xxhash64("_length", "_leaf", part)).drop("_leaf", "_parts")


def boxes(dealt: DataFrame) -> DataFrame:
    """_shard, _length, _low, _high: the tight box of each shard."""

    def some(batch):
        shards = batch["_shard"].to_numpy()
        for shard in np.unique(shards).tolist():
            own = batch.filter(pa.array(shards == shard))
            values = own["_vector"].flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            yield {"_shard": [shard], "_length": [values.shape[1]], "_low": [values.min(axis=0)], "_high": [values.max(axis=0)]}

    def whole(table: pa.Table) -> pa.Table:
        low, high = (f(np.array(table[c].to_pylist()), axis=0) for f, c in ((np.min, "_low"), (np.max, "_high")))
        return pa.table({"_shard": table["_shard"][:1], "_length": table["_length"][:1], "_low": pa.array([low], pa.list_(pa.int64())), "_high": pa.array([high], pa.list_(pa.int64()))})

    kinds = "_shard long, _length int, _low array<long>, _high array<long>"
    return common.arrow_map(dealt.select("_shard", "_vector"), some, kinds).groupBy("_shard").applyInArrow(whole, kinds)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(*[F.col(c).alias(f"{c}_asked") for c in queries.columns])


def _points(rows: pa.Table, column: str) -> np.ndarray:
    column_ = rows[column].combine_chunks()
    return column_.flatten().to_numpy(zero_copy_only=False).reshape(len(column_), -1)


def _bounds(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What each box allows each query; sums of doubles may fall short, so a little more."""
    points = points.astype(np.float64)
    bounds = np.maximum(points, 0) @ high.T + np.minimum(points, 0) @ low.T
    return bounds + np.abs(bounds) * 1e-9 + 1


def _against_boxes(queries: DataFrame, held: DataFrame, boxes_: int, run, kinds: str) -> DataFrame:
    """``run(boxes, queries)`` over blocks of boxes and parts of queries (column _part)."""
    blocks = max(1, -(-boxes_ // BOX_BLOCK))
    parts = queries.select("_part", "_length").distinct()
    boxed = held.withColumn("_block", F.pmod(F.xxhash64("_shard"), F.lit(blocks)).cast("int")).join(common.small(common.stage(parts, "parts")), "_length")
    asked = _asked(queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    keys = ["_block", "_part", "_length"]
    return boxed.groupBy(*keys).cogroup(asked.groupBy(*[f"{c}_asked" for c in keys])).applyInArrow(run, kinds)


def homes(queries: DataFrame, held: DataFrame, boxes_: int) -> DataFrame:
    """_row, _shard: the shard whose box allows each query the most."""

    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"_row": [], "_shard": [], "_bound": []}
        if len(rows) and len(asked):
            low, high = (np.array(rows[c].to_pylist(), np.float64) for c in ("_low", "_high"))
            points, shards = _points(asked, "_vector_asked"), rows["_shard"].to_numpy()
            for at in range(0, len(asked), QUERY_BLOCK):
                bounds = _bounds(points[at : at + QUERY_BLOCK], low, high)
                best = bounds.argmax(axis=1)
                out["_row"].append(asked["_row_asked"].to_numpy()[at : at + QUERY_BLOCK])
                out["_shard"].append(shards[best])
                out["_bound"].append(bounds[np.arange(len(best)), best])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.float64() if c == "_bound" else pa.int64()) for c, v in out.items()})

    parts = max(1, -(-queries.count() // TASK_QUERIES))
    dealt = queries.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    found = _against_boxes(dealt, held, boxes_, run, "_row long, _shard long, _bound double")
    return found.groupBy("_row").agg(F.max_by("_shard", F.struct("_bound", "_shard")).alias("_shard"))


def wanted(queries: DataFrame, held: DataFrame, boxes_: int) -> DataFrame:
    """_part, _shard, _bound: the shards that some query of a part can reach with its _floor, but for those it comes from (_home), and how much they allow."""

    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({"_part": pa.array([], pa.int64()), "_shard": pa.array([], pa.int64()), "_bound": pa.array([], pa.float64())})
        low, high = (np.array(rows[c].to_pylist(), np.float64) for c in ("_low", "_high"))
        points, shards = _points(asked, "_vector_asked"), rows["_shard"].to_numpy()
        floors, home = asked["_floor_asked"].to_numpy(), asked["_home_asked"].to_numpy()
        most = np.full(len(shards), -np.inf)
        for at in range(0, len(asked), QUERY_BLOCK):
            bounds = _bounds(points[at : at + QUERY_BLOCK], low, high)
            out = (bounds < floors[at : at + QUERY_BLOCK, None]) | (home[at : at + QUERY_BLOCK, None] == shards)
            most = np.maximum(most, np.where(out, -np.inf, bounds).max(axis=0))
        near = np.isfinite(most)
        return pa.table({"_part": pa.array(np.full(int(near.sum()), key[1].as_py())), "_shard": pa.array(shards[near]), "_bound": pa.array(most[near])})

    return _against_boxes(queries, held, boxes_, run, "_part long, _shard long, _bound double")


PACKED = "_part long, _ids binary, _homes binary, _floors binary, _vectors binary"


def packed(queries: DataFrame) -> DataFrame:
    """Blocks of up to ``QUERY_BLOCK`` queries of one part and length, each one row."""

    def rows(batches):
        for batch in batches:
            part, length = batch["_part"].to_numpy(), batch["_length"].to_numpy()
            if not len(part):
                continue
            edges = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (length[1:] != length[:-1])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
                for at in range(a, b, QUERY_BLOCK):
                    own = batch.slice(at, min(QUERY_BLOCK, b - at))
                    columns = [own[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "_home", "_floor")]
                    values = own["_vector"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int64()), *[pa.array([c], pa.binary()) for c in (*columns, values)]], names=["_part", "_ids", "_homes", "_floors", "_vectors"])

    ordered = queries.select("_part", "_length", "vec_id", "_home", "_floor", "_vector").repartition("_part", "_length").sortWithinPartitions("_part", "_length")
    return ordered.mapInArrow(rows, PACKED)


def _alike(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Queries in the tree's own kind of number, or both as longs where doubles are not exact."""
    exact = tree.vectors.dtype == np.float64 and int(np.abs(points).max(initial=0)) * int(np.abs(tree.vectors).max(initial=0)) * points.shape[1] < 2**53
    if not exact:
        tree.vectors, tree.low, tree.high = (x.astype(np.int64) for x in (tree.vectors, tree.low, tree.high))
    return points.astype(tree.vectors.dtype)


def _found(rows: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table({c: pa.array([x[i] for x in rows], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})


def search(dealt: DataFrame, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best that each query has in each group of shards.

    ``asked`` (staged) has vec_id, _vector, _length, _floor, _home and _part, ``pairs``
    (staged) the _shard s that a _part goes through with their _bound.
    """

    def run(key, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if not len(rows) or not len(blocks):
            return _found(out)
        shards, worth = rows["_shard"].to_numpy(), rows["_bound"].to_numpy()
        order = sorted(set(zip((-worth).tolist(), shards.tolist(), strict=True)))
        asked = [[np.frombuffer(x, np.int64) for x in (r["_ids_asked"], r["_homes_asked"], r["_floors_asked"], r["_vectors_asked"])] for r in blocks.to_pylist()]
        best: list[list[list[tuple[int, int]]]] = [[[] for _ in ids] for ids, *_ in asked]
        floors = [f.astype(np.float64) for _, _, f, _ in asked]
        for _, shard in order:
            own = rows.filter(pa.array(shards == shard))
            tree = Tree(own["vec_id"].to_numpy(), _matrix(own["_vector"]))
            for (ids, home, _, flat), found, floor in zip(asked, best, floors, strict=True):
                points = flat.reshape(len(ids), -1)
                if points.shape[1] != tree.vectors.shape[1]:
                    continue
                points = _alike(tree, points)
                bounds = tree.bounds(points)
                for i in np.flatnonzero((home != shard) & (bounds[:, 0] >= floor)).tolist():
                    # a row of the query's own id and equal scores are told apart by the tree itself
                    both = sorted(found[i] + tree.search(int(ids[i]), points[i], bounds[i].tolist(), k, float(floor[i])), key=lambda x: (-x[0], x[1]))[:k]
                    found[i] = both
                    if len(both) == k:
                        floor[i] = max(floor[i], both[-1][0])
        for (ids, *_), found in zip(asked, best, strict=True):
            out += [(int(q), v, s) for q, own in zip(ids.tolist(), found, strict=True) for s, v in own]
        return _found(out)

    parts, shards = pairs.select("_part").distinct().count(), pairs.select("_shard").distinct().count()
    # few parts go through smaller groups, so that every core has a search to do
    cores = dealt.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-shards // TASK_SHARDS), min(shards, -(-2 * cores // max(1, parts))))
    group = F.pmod(F.xxhash64("_shard"), F.lit(groups))
    goes = common.small(pairs)
    held = dealt.join(goes, "_shard").withColumn("_group", group).select("_part", "_group", "_shard", "_bound", "vec_id", "_vector")
    blocks = packed(asked).join(common.small(common.stage(pairs.select("_part", group.alias("_group")).distinct(), "part-groups")), "_part")
    # little to read and much to do: as many tasks as there are searches, not as their bytes fill
    tasks = max(1, min(MOST_TASKS, 2 * pairs.select("_part", group.alias("_group")).distinct().count()))
    keys = ["_part", "_group"]
    asked_keys = [f"{c}_asked" for c in keys]
    return held.repartition(tasks, *keys).groupBy(*keys).cogroup(_asked(blocks).repartition(tasks, *asked_keys).groupBy(*asked_keys)).applyInArrow(run, FOUND)


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every``, its k best others (staged)."""
    with common.scratch(table.sparkSession):
        return common.stage(_top_k(table, k, every, scale), "top-k", keep=True)


def _top_k(table: DataFrame, k: int, every: int, scale: int) -> DataFrame:
    # the number is staged with the row, so that a row is dealt alike each time
    every_vector = common.stage(vectors(table, scale).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    rows = every_vector.count()
    if rows <= SHARD_ROWS:  # one shard of each length: there is no other to go on to
        whole = every_vector.withColumn("_shard", F.xxhash64("_length"))
        queries = whole.where(F.col("vec_id") % every == 0).withColumns({"_floor": F.lit(NO_FLOOR), "_home": F.lit(0).cast("long"), "_part": F.col("_shard")})
        own = common.stage(queries.select("_part", "_shard").distinct().withColumn("_bound", F.lit(0.0)), "own-shards")
        return ranked(search(whole, queries, own, k))
    dealt = common.stage(deal(every_vector, rows), "shards")
    held = common.stage(boxes(dealt), "boxes")
    queries = dealt.where(F.col("vec_id") % every == 0).drop("_shard")
    count = held.count()

    home = common.stage(homes(queries, held, count), "homes")
    # queries that begin at one shard are alike: they form parts, split where a shard has many
    many = home.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n")).select("_shard", F.expr(f"(_n + {TASK_QUERIES - 1}) div {TASK_QUERIES}").alias("_split"))
    at_home = home.join(common.small(common.stage(many, "home-parts")), "_shard").withColumn("_part", F.xxhash64("_shard", F.pmod(F.xxhash64("_row"), F.col("_split"))))
    at_home = common.stage(queries.join(at_home.select("_row", "_part", F.col("_shard").alias("_from")), "_row"), "queries")
    begin = at_home.withColumns({"_floor": F.lit(NO_FLOOR), "_home": F.lit(0).cast("long")})  # no shard is left out yet
    own = common.stage(at_home.select("_part", F.col("_from").alias("_shard")).distinct().withColumn("_bound", F.lit(0.0)), "home-pairs")
    first = common.stage(search(dealt, begin, own, k), "home")

    floors = first.groupBy("query_id").agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("_n") >= k, F.col("_least")).alias("_floor"))
    # a query that has not found k yet goes on to every shard; parts of neighbours now fill up to a task
    parts = max(1, -(-at_home.count() // TASK_QUERIES))
    floored = at_home.join(floors, "vec_id", "left").withColumn("_floor", F.coalesce("_floor", F.lit(NO_FLOOR)))
    floored = common.stage(floored.withColumn("_part", F.pmod(F.xxhash64("_from"), F.lit(parts))).withColumnRenamed("_from", "_home"), "floors")
    pairs = common.stage(wanted(floored, held, count), "pairs")
    return ranked(first.unionByName(search(dealt, floored, pairs, k)))
