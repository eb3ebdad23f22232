"""Catalog trees: schemas and tables, partition hierarchies and their leaves, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.functions import expressions as X
from tablehealth.operators.history import union_all
from tablehealth.operators.ranking import numbered
from tablehealth.sources.catalog import Catalog
from tablehealth.sources.files import keep, staging


def object_tree(catalog: Catalog) -> DataFrame:
    """schema_name, table_name, relkind, full_name of user tables that are no partition of another."""
    spaces = catalog.namespaces.where(~F.col("nspname").isin(*X.SYSTEM_SCHEMAS))
    for pattern in X.TEMPORARY_SCHEMAS:
        spaces = spaces.where(~F.col("nspname").like(pattern))
    tables = catalog.relations.where(F.col("relkind").isin("r", "p"))
    tops = tables.join(catalog.inheritance, F.col("oid") == F.col("inhrelid"), "left_anti")
    named = tops.join(spaces.select(F.col("oid").alias("_space"), "nspname"), F.col("relnamespace") == F.col("_space"))
    return named.select(F.col("nspname").alias("schema_name"), F.col("relname").alias("table_name"), "relkind", X.qualified(F.col("nspname"), F.col("relname")).alias("full_name"))


def nested_tree(tree: DataFrame) -> DataFrame:
    """One row per schema with its tables nested in name order."""
    table = F.struct(F.col("table_name").alias("table"), "relkind", "full_name")
    return tree.groupBy(F.col("schema_name").alias("schema")).agg(F.array_sort(F.collect_list(table)).alias("tables"))


def schema_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("schema_name").agg(F.count(F.lit(1)).alias("table_count"), F.count_if(F.col("relkind") == "p").alias("partitioned_count"))


def totals(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count_distinct("schema_name").alias("schemas"), F.count(F.lit(1)).alias("tables"))


def search(tree: DataFrame, text: str) -> DataFrame:
    """Tables whose schema or full name contains ``text``, whatever the case; blank keeps all."""
    needle = text.strip().lower()
    if not needle:
        return tree
    return tree.where(F.lower("schema_name").contains(needle) | F.lower("full_name").contains(needle))


def tri_state(selection: DataFrame, *by: str) -> DataFrame:
    """State of each group of a (…, checked) selection: none, some or all; with selected counts."""
    grouped = selection.groupBy(*by) if by else selection
    return grouped.agg(X.tri_state(F.col("checked")).alias("state"), F.count_if(F.col("checked").cast("boolean")).alias("selected"))


class CycleError(ValueError):
    """Edges that lead back to where they came from; ``nodes`` are some of those involved."""

    def __init__(self, nodes: list[str]):
        super().__init__(f"cycle among {', '.join(nodes)}")
        self.nodes = nodes


def walk(edges: DataFrame, roots: DataFrame, small: int = 1 << 20) -> DataFrame:
    """root, node, level_no: everything below the roots; a node that paths of one length reach is there once.

    ``edges`` has parent and child, ``roots`` has node.  Pointers are doubled: round k knows
    all nodes within 2**k steps of the roots and all pairs 2**k steps apart, so a hierarchy
    of any depth takes as many rounds as its depth has bits.  Each round is staged.  Where
    paths are longer than there are edges they run in a circle, which is a CycleError.

    More edges than ``small`` are thinned before: leaves go, then nodes with one parent hand
    their children up to it, about a quarter of them a round.  What went is put back at the
    end, last first, so that all rounds together move a few times the edges, however deep.
    """
    spark = edges.sparkSession
    with staging(spark, "walk") as stage:
        start = stage(edges.select("parent", "child").distinct())
        found = stage(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("level_no", F.lit(0).cast("long")))
        left, gone = start.withColumn("steps", F.lit(1).cast("long")), []
        if start.count() > small:
            left, leafs = _without_leaves(left, stage, small)
            left, within = _without_only_children(left, roots, stage, small)
            gone = leafs + within
        found = _doubled(found, left, gone, stage)
        for _, taken, hand in reversed(gone):
            below = taken.withColumnRenamed("steps", "_steps")
            # whoever took a node in is no head of that round
            above = found if hand is None else found.where(~_head(F.col("node"), hand))
            back = above.join(below, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), (F.col("level_no") + F.col("_steps")).alias("level_no"))
            found = found.unionByName(stage(back.distinct() if hand is None else back))
        # the staged rows go when this function ends: what leaves it is checkpointed beside them
        return keep(found.withColumn("level_no", F.col("level_no").cast("int")))


def _doubled(found: DataFrame, edges: DataFrame, gone: list, stage) -> DataFrame:
    """``found`` with all nodes below its own, along edges that stand for one step or more."""
    apart = stage(edges.select("parent", "child", "steps").distinct())
    most, rounds = apart.count(), 1
    while not apart.isEmpty():
        if rounds > most:
            raise CycleError(_circle(apart, gone, stage))
        further = found.join(apart, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), (F.col("level_no") + F.col("steps")).alias("level_no")).distinct()
        found = stage(found.unionByName(further))
        left, right = apart, apart.select(F.col("parent").alias("_middle"), F.col("child").alias("_end"), F.col("steps").alias("_more"))
        apart = stage(left.join(right, F.col("child") == F.col("_middle")).select("parent", F.col("_end").alias("child"), (F.col("steps") + F.col("_more")).alias("steps")).distinct())
        rounds *= 2
    # paths of several numbers of edges may be equally long once edges stand for several steps
    return stage(found.distinct()) if gone else found


def _head(node: Column, number: int) -> Column:
    """A coin for each node, another one each round."""
    return F.xxhash64(F.lit(number), node).bitwiseAND(1) == 1


def _without_leaves(edges: DataFrame, stage, small: int) -> tuple[DataFrame, list]:
    """Edges without those to leaves, again and again while leaves are half of them; and what went, round by round."""
    gone, n = [], edges.count()
    while n > small:
        inner = edges.select(F.col("parent").alias("_inner")).distinct()
        tagged = stage(edges.join(inner, F.col("child") == F.col("_inner"), "left").select("parent", "child", "steps", F.col("_inner").isNull().alias("_leaf")))
        left, taken = tagged.where("NOT _leaf").drop("_leaf"), tagged.where("_leaf").drop("_leaf")
        kept = left.count()
        if kept == n:
            break
        gone.append((edges, taken, None))
        edges = left
        if 2 * kept > n:
            break
        n = kept
    return edges, gone


def _without_only_children(edges: DataFrame, roots: DataFrame, stage, small: int) -> tuple[DataFrame, list]:
    """Edges without nodes that have one parent, until few are left or most nodes have several; and what went.

    A node goes if its coin is a head and its parent's is not, so a parent that takes
    children over stays.  Roots stay.
    """
    n = edges.count()
    if n <= small:
        return edges, []
    single = edges.groupBy("child").agg(F.count(F.lit(1)).alias("_parents")).where("_parents = 1").select(F.col("child").alias("_single"))
    single = single.join(roots.select(F.col("node").alias("_single")), "_single", "left_anti")
    free = F.col("_single").isNotNull() & (F.col("parent") != F.col("child"))
    edges = stage(edges.join(single, F.col("child") == F.col("_single"), "left").select("parent", "child", "steps", F.coalesce(free, F.lit(False)).alias("free")))
    gone, number = [], 0
    while True:
        n, frees = edges.agg(F.count(F.lit(1)), F.count_if("free")).first()
        if n <= small or 2 * frees <= n:
            return edges.drop("free"), gone
        number += 1
        goes = F.col("free") & _head(F.col("child"), number) & ~_head(F.col("parent"), number)
        taken = stage(edges.where(goes).select("parent", "child", "steps"))
        # only below heads can a parent have gone; all other edges stay as they are, without a shuffle
        same = edges.where(~_head(F.col("parent"), number) & ~goes)
        up = taken.select(F.col("parent").alias("_up"), F.col("child").alias("_gone"), F.col("steps").alias("_more"))
        parent = F.coalesce("_up", "parent")
        moved = edges.where(_head(F.col("parent"), number)).join(up, F.col("parent") == F.col("_gone"), "left").select(
            parent.alias("parent"), "child", (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), (F.col("free") & (parent != F.col("child"))).alias("free"))
        gone.append((edges.drop("free"), taken, number))
        edges = stage(same.unionByName(moved))


def _circle(apart: DataFrame, gone: list, stage) -> list[str]:
    """Nodes that endless paths both lead to and come from, those that had gone among them."""
    after, before = (apart.select(F.col(c).alias("node")).distinct() for c in ("child", "parent"))
    for edges, taken, hand in reversed(gone):
        if hand is None:  # no path leads on from a leaf
            continue
        late = taken.join(after, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node"))
        early = edges.join(before, F.col("child") == F.col("node"), "left_semi").select(F.col("parent").alias("node")).distinct()
        early = taken.join(early, F.col("child") == F.col("node"), "left_semi").select(F.col("child").alias("node"))
        after, before = after.unionByName(stage(late)), before.unionByName(stage(early))
    return [r["node"] for r in before.join(after, "node", "left_semi").orderBy("node").limit(20).collect()]


def hierarchy(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``walk`` with is_leaf: a node that is nobody's parent."""
    parents = edges.select(F.col("parent").alias("_parent")).distinct()
    return walk(edges, roots).join(parents, F.col("node") == F.col("_parent"), "left").select("root", "node", "level_no", F.col("_parent").isNull().alias("is_leaf"))


def leaves(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return hierarchy(edges, roots).where("is_leaf").drop("is_leaf")


def expand(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Leaves of all selected roots, each once, at the place where it first came up.

    ``selected`` has pos and node; a root that occurs twice adds nothing.
    """
    found = leaves(edges, selected.select("node").distinct()).join(selected.select("pos", F.col("node").alias("root")), "root")
    first = found.groupBy("node").agg(F.min(F.struct("pos", "level_no")).alias("_first"))
    return numbered(first, F.col("_first.pos"), F.col("_first.level_no"), F.col("node")).select("node", "position")


def relation_edges(catalog: Catalog) -> DataFrame:
    """Partition edges between qualified names."""
    spaces = catalog.namespaces.select(F.col("oid").alias("_space"), "nspname")
    names = catalog.relations.join(spaces, F.col("relnamespace") == F.col("_space")).select("oid", X.qualified(F.col("nspname"), F.col("relname")).alias("name"))
    parent, child = (names.select(F.col("oid").alias(f"_{k}"), F.col("name").alias(k)) for k in ("parent", "child"))
    return catalog.inheritance.join(parent, F.col("inhparent") == F.col("_parent")).join(child, F.col("inhrelid") == F.col("_child")).select("parent", "child")


__all__ = ["expand", "hierarchy", "leaves", "nested_tree", "object_tree", "relation_edges", "schema_counts", "search", "totals", "tri_state", "union_all", "walk"]
