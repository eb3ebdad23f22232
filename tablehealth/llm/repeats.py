"""Passages that occur again elsewhere, found without comparing pairs of documents.

A window is ``window`` consecutive units (bytes or words) of one document.  Two equal
windows share the anchor that winnowing picks in them: the smallest ``gram``-unit hash.
Runs of windows with one anchor form a block, and the work proceeds by buckets:

1. Blocks are counted by anchor.  A bucket of one is dropped: nothing in it repeats.
2. Blocks with the same span (all units of their windows) form one class, and equal spans
   settle all their windows at once: a passage copied a million times costs one row per block.
3. Where one anchor stands in different spans, one representative of each class is cut out
   of its text and the bucket is resolved by the operator's own method (``Rule.resolve``).
   A bucket of more than ``BUCKET_BYTES`` is split first: windows at like distances from
   the anchor go together, in buckets by the text that all windows at these distances
   hold.  What is still too large is compared window by window, as rows grouped by content.
   Where the document of a representative holds its span again, the verdicts hold there too.

A rule decides which windows of equal content go.  ``SEEN_ELSEWHERE``: content that
starts at two positions or more, everywhere it stands.  ``SEEN_EARLIER``: content that a
document with a smaller doc_id holds.

All grouping is by partial aggregates or size-checked joins, so hot passages do not
gather in one task, and no task holds more of a bucket than its bound.  Classes and split
buckets are equal by 128-bit hashes.  Null texts are empty, texts shorter than a window
keep everything, a null doc_id counts as larger than any other, repeated rows are
separate places of one doc_id, an empty table gives no cuts; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, scan

SEEN_ELSEWHERE, SEEN_EARLIER = "elsewhere", "earlier"
#: Text of different spans with one anchor that a task holds at most.
BUCKET_BYTES = 1 << 17
#: Text that is resolved at a time, in whole buckets.
POOL_BYTES = 1 << 18
#: Windows of a span that go together when a bucket is split.
STEP = 16


@dataclass(frozen=True)
class Pool:
    """Spans of whole buckets: their text, bucket number, anchor (a unit of the span) and doc_id."""

    spans: scan.Slice
    bucket: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


@dataclass(frozen=True)
class Rule:
    """What a window is, how anchors are picked, which repeats count and how a bucket is resolved."""

    unit: str  # "byte" or "word"
    window: int
    gram: int
    seen: str
    resolve: Callable[[Pool, int], tuple[np.ndarray, np.ndarray]]  # (span, window within it) of repeating windows

    def units(self, s: scan.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units as items to hash, as codes to pick anchors by, and each document's unit offsets."""
        if self.unit == "byte":
            return s.data, s.codes(), s.offsets
        w = s.words()
        first = w.hashes(0)
        return np.stack([first, w.hashes(1)], axis=1), first, w.offsets


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*common.row_id(), F.col("text").cast("string"))


BLOCKS = "anchor long, h0 long, h1 long, _doc long, _key long, at long, n int, mid int, bytes int"


def blocks(docs: DataFrame, rule: Rule) -> DataFrame:
    """Each run of n windows from unit ``at`` on with one anchor, ``mid`` units further on: its span's hash and bytes."""

    def rows(batch):
        for s in scan.slices(batch["text"]):
            words = s.words() if rule.unit == "word" else None
            items, codes, offsets = rule.units(s)
            grams = scan.Rolling(codes).windows(rule.gram)
            anchor = scan.winnow(grams, rule.window - rule.gram + 1)
            starts = np.flatnonzero(scan.whole_windows(offsets, rule.window, len(codes)))
            if not len(starts):
                continue
            own = anchor[starts]
            opens = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))
            begin, last = starts[opens], starts[np.append(opens[1:], len(starts)) - 1]
            end = last + rule.window
            owner = np.searchsorted(offsets, begin, "right") - 1
            take = pa.array(owner + s.first)
            h0, h1 = scan.digests(items, begin, end)
            yield {
                "anchor": grams[own[opens]],
                "h0": h0,
                "h1": h1,
                "_doc": batch["_doc"].take(take),
                "_key": batch["_key"].take(take),
                "at": begin - offsets[owner],
                "n": (last - begin + 1).astype(np.int32),
                "mid": (own[opens] - begin).astype(np.int32),
                "bytes": ((words.end[end - 1] - words.start[begin]) if words else end - begin).astype(np.int32),
            }

    return common.arrow_map(keyed(docs), rows, BLOCKS)


def _repeated(grouped, rule: Rule) -> DataFrame:
    """Groups of blocks in which some window may repeat under the rule."""
    if rule.seen == SEEN_ELSEWHERE:
        return grouped.agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > 1)
    return grouped.agg(F.min("_doc").alias("_low"), F.max("_doc").alias("_high")).where(F.col("_low") < F.col("_high"))


def _runs(owner: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of one owner as (owner, first unit, unit behind the last)."""
    if not len(at):
        return owner, at, at
    opens = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
    return owner[opens], at[opens], at[np.append(opens[1:], len(at)) - 1] + window


def cuts(docs: DataFrame, rule: Rule) -> DataFrame:
    """_doc, _key, starts, ends: for each row with repeats, its maximal runs of units to remove (staged)."""
    with common.scratch(docs.sparkSession):
        return common.stage(_cuts(docs, rule), "cuts", keep=True)


def _cuts(docs: DataFrame, rule: Rule) -> DataFrame:
    every = blocks(docs, rule)
    anchors = common.stage(_repeated(every.groupBy("anchor"), rule).select("anchor"), "anchors")
    held = every.join(F.broadcast(anchors), "anchor", "left_semi") if common.fits(anchors) else common.thin(every, anchors, ["anchor"]).join(anchors, "anchor", "left_semi")
    held = common.stage(held, "blocks")

    spans = held.groupBy("anchor", "h0", "h1").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("_doc", "_key", "at", "n", "mid", "bytes")).alias("first"), F.max("_doc").alias("_high")
    )
    spans = common.stage(spans.select("anchor", "h0", "h1", "weight", "first.*", "_high"), "spans")

    # whole spans that repeat settle their blocks
    if rule.seen == SEEN_ELSEWHERE:
        again = spans.where(F.col("weight") > 1).select("h0", "h1", F.lit(-1).cast("long").alias("_least"))
    else:
        again = spans.where(F.col("_doc") < F.col("_high")).select("h0", "h1", F.col("_doc").alias("_least"))
    again = common.stage(again, "settled-spans")
    settled = held.join(common.small(again), ["h0", "h1"]).where(F.col("_doc") > F.col("_least")).select(*common.ROW, F.col("at").alias("start"), (F.col("at") + F.col("n") + (rule.window - 1)).alias("end"))

    # anchors in different spans: one representative of each
    mixed = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("_spans"), F.sum("bytes").alias("_bytes")).where(F.col("_spans") > 1)
    mixed = common.stage(mixed.select("anchor", (F.col("_bytes") > BUCKET_BYTES).alias("hot")), "mixed-anchors")
    reps = spans.join(common.small(mixed), "anchor")
    cut = common.stage(_cut_out(docs, reps, rule), "representatives")
    split = cut.where("hot").groupBy("b0", "b1").agg(F.count(F.lit(1)).alias("_spans"), F.sum(F.octet_length("span")).alias("_bytes")).where(F.col("_spans") > 1)
    split = common.small(common.stage(split, "split-buckets"))
    hot = cut.where("hot").join(split, ["b0", "b1"])
    bounded = cut.where(~F.col("hot")).unionByName(hot.where(F.col("_bytes") <= BUCKET_BYTES).drop("_spans", "_bytes"))
    found = _within_tasks(bounded, rule).unionByName(_by_rows(hot.where(F.col("_bytes") > BUCKET_BYTES), rule))
    if rule.seen == SEEN_EARLIER:
        found = common.stage(found, "runs")
        found = found.unionByName(_at_other_places(found, held, reps))
    return _merge(settled.unionByName(found.drop("at")))


def _at_other_places(found: DataFrame, held: DataFrame, reps: DataFrame) -> DataFrame:
    """The runs of a representative at the other places of its span in its own document.

    Elsewhere a span that stands twice goes as a whole; here the first document that holds
    it keeps it, and may hold it several times.
    """
    many = common.stage(reps.where(F.col("weight") > 1).select("anchor", "h0", "h1", "_doc", F.col("_key").alias("_rep"), F.col("at").alias("_at")), "repeated-spans")
    twins = held.join(common.small(many), ["anchor", "h0", "h1", "_doc"]).where((F.col("_key") != F.col("_rep")) | (F.col("at") != F.col("_at")))
    twins = common.stage(twins.select("_doc", F.col("_rep").alias("_key"), F.col("_at").alias("at"), F.col("_key").alias("_twin"), (F.col("at") - F.col("_at")).alias("_shift")), "other-places")
    moved = found.join(common.small(twins), [*common.ROW, "at"])
    return moved.select("_doc", F.col("_twin").alias("_key"), *[(F.col(c) + F.col("_shift")).alias(c) for c in ("at", "start", "end")])


CUT = "b0 long, b1 long, at long, skip int, mid int, weight long, hot boolean, _doc long, _key long, span binary"


def _cut_out(docs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """The text of each representative span, with its bucket, weight and place.

    Spans of hot buckets come in parts of up to ``STEP`` windows, at fixed distances from
    the anchor, in buckets by what all windows at these distances hold.
    """
    wanted = common.stage(reps.groupBy(*common.ROW).agg(F.collect_list(F.struct("at", "n", "mid", "anchor", "weight", "hot")).alias("spans")), "wanted")
    ids, texts = wanted.select(*common.ROW), keyed(docs)
    texts = texts.join(F.broadcast(ids), common.ROW, "left_semi") if common.fits(ids) else common.thin(texts, ids, common.ROW).join(ids, common.ROW, "left_semi")
    texts = texts.dropDuplicates(common.ROW)

    def parts(own: dict, items: np.ndarray):
        """(b0, b1, skip, mid, windows) of each part of a span."""
        if not own["hot"]:
            yield own["anchor"], 0, 0, own["mid"], own["n"]
            return
        top = own["mid"] // STEP  # windows that start mid, mid - 1, ... units before the anchor
        for group in range((own["mid"] - own["n"] + 1) // STEP, top + 1):
            far, near = min(own["mid"], group * STEP + STEP - 1), max(own["mid"] - own["n"] + 1, group * STEP)
            core = own["at"] + own["mid"] - group * STEP
            h0, h1 = scan.digests(items, np.array([core]), np.array([core - STEP + 1 + rule.window]))
            b0 = h0 ^ scan.mix(np.array([own["anchor"] + group]).astype(np.int64).view(np.uint64))
            yield int(b0.view(np.int64)[0]), int(h1.view(np.int64)[0]), own["mid"] - far, far, far - near + 1

    def rows(batch):
        for i in range(batch.num_rows):
            s = next(scan.slices(batch["text"].slice(i, 1)))
            own = batch["spans"][i].as_py()
            items = rule.units(s)[0] if any(x["hot"] for x in own) else None
            cut = [(x, *p) for x in own for p in parts(x, items)]
            begin = np.array([x["at"] + skip for x, _, _, skip, _, _ in cut])
            to = begin + np.array([n for *_, n in cut]) + (rule.window - 1)
            if rule.unit == "word":
                w = s.words()
                begin, to = w.start[begin], w.end[to - 1]
            raw = s.data.tobytes()
            yield {c: [x[c] for x, *_ in cut] for c in ("at", "weight", "hot")} | {c: [x[k] for x in cut] for k, c in ((1, "b0"), (2, "b1"), (3, "skip"), (4, "mid"))} | {
                "_doc": np.full(len(cut), batch["_doc"][i].as_py()),
                "_key": np.full(len(cut), batch["_key"][i].as_py()),
                "span": [raw[a:b] for a, b in zip(begin.tolist(), to.tolist(), strict=True)],
            }

    return common.arrow_map(texts.join(wanted, common.ROW), rows, CUT)


def _within_tasks(cut: DataFrame, rule: Rule) -> DataFrame:
    """Resolve whole buckets, as many at a time as fill a pool."""

    def resolve(table: pa.Table):
        data, offsets = scan.buffers(table["span"])
        b0, b1 = table["b0"].to_numpy(), table["b1"].to_numpy()
        bucket = np.cumsum(np.append(0, (b0[1:] != b0[:-1]) | (b1[1:] != b1[:-1])))
        owner, at = rule.resolve(Pool(scan.Slice(data, offsets), bucket, table["mid"].to_numpy(), table["_doc"].to_numpy()), rule.window)
        order = np.lexsort((at, owner))
        owner, start, end = _runs(owner[order], at[order], rule.window)
        base = table["at"].to_numpy()[owner]
        place = base + table["skip"].to_numpy()[owner]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (table["_doc"].to_numpy()[owner], table["_key"].to_numpy()[owner], base, place + start, place + end)], names=["_doc", "_key", "at", "start", "end"])

    def run(batches):
        held, size = [], 0
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                b0, b1 = table["b0"].to_numpy(), table["b1"].to_numpy()
                begin = 0
                for to in [*(np.flatnonzero((b0[1:] != b0[:-1]) | (b1[1:] != b1[:-1])) + 1).tolist(), len(b0)]:
                    if held and size > POOL_BYTES and (b0[begin], b1[begin]) != (held[-1]["b0"][-1].as_py(), held[-1]["b1"][-1].as_py()):
                        yield resolve(pa.concat_tables(held))
                        held, size = [], 0
                    held.append(table.slice(begin, to - begin))
                    size += scan.byte_count(held[-1]["span"])
                    begin = to
            if held:
                yield resolve(pa.concat_tables(held))
        finally:
            common.give_back()

    ordered = cut.select("b0", "b1", "at", "skip", "mid", *common.ROW, "span").repartition("b0", "b1").sortWithinPartitions("b0", "b1")
    common.short_batches(cut.sparkSession)
    return ordered.mapInArrow(run, "_doc long, _key long, at long, start long, end long")


def _by_rows(cut: DataFrame, rule: Rule) -> DataFrame:
    """The same for buckets that stay large: one row per window, grouped by its content."""

    def rows(batch):
        for s in scan.slices(batch["span"]):
            items, _, offsets = rule.units(s)
            starts = np.flatnonzero(scan.whole_windows(offsets, rule.window, len(items)))
            owner = np.searchsorted(offsets, starts, "right") - 1
            own = batch.slice(s.first, len(s)).take(pa.array(owner))
            w0, w1 = scan.digests(items, starts, starts + rule.window)
            yield {"w0": w0, "w1": w1, "start": own["at"].to_numpy() + own["skip"].to_numpy() + starts - offsets[owner]} | {c: own[c] for c in ("weight", "_doc", "_key", "at")}

    windows = common.arrow_map(cut.select("weight", *common.ROW, "at", "skip", "span"), rows, "w0 long, w1 long, weight long, _doc long, _key long, at long, start long")
    windows = common.stage(windows, "windows")
    groups = windows.groupBy("w0", "w1").agg(F.sum("weight").alias("_weight"), F.min("_doc").alias("_low"), F.max("_doc").alias("_high"))
    if rule.seen == SEEN_ELSEWHERE:
        groups = groups.where(F.col("_weight") > 1).select("w0", "w1", F.lit(-1).cast("long").alias("_least"))
    else:
        groups = groups.where(F.col("_low") < F.col("_high")).select("w0", "w1", F.col("_low").alias("_least"))
    groups = common.small(common.stage(groups, "window-groups"))
    return windows.join(groups, ["w0", "w1"]).where(F.col("_doc") > F.col("_least")).select(*common.ROW, "at", "start", (F.col("start") + rule.window).alias("end"))


def _merge(found: DataFrame) -> DataFrame:
    """Union of the runs of each row; a row's runs are bounded by its own text."""

    def rows(batch):
        starts, ends = [], []
        for runs in batch["runs"].to_pylist():
            a, b = [], []
            for run in sorted((r["start"], r["end"]) for r in runs):
                if b and run[0] <= b[-1]:
                    b[-1] = max(b[-1], run[1])
                else:
                    a.append(run[0])
                    b.append(run[1])
            starts.append(a)
            ends.append(b)
        yield {"_doc": batch["_doc"], "_key": batch["_key"], "starts": starts, "ends": ends}

    grouped = found.groupBy(*common.ROW).agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    return common.arrow_map(grouped, rows, "_doc long, _key long, starts array<long>, ends array<long>")


def attach(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their ``row_id`` and their cuts beside them: _starts and _ends (null: none)."""
    runs, n = found.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0)), F.count(F.lit(1))).first()
    found = found.select(*common.ROW, F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    if runs * 16 + n * common.row_bytes(found) <= common.broadcast_limit(docs.sparkSession):
        return docs.join(F.broadcast(found), common.ROW, "left")
    # texts without cuts stay where they are
    cut, whole = common.parted(docs, found, common.ROW)
    joined = cut.join(found, common.ROW, "left")
    return joined if whole is None else joined.unionByName(whole.withColumns({c: F.lit(None).cast("array<long>") for c in ("_starts", "_ends")}))
