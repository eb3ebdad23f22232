"""Mixing sources to target weights along a low-discrepancy schedule.

Every source's documents are put in a hashed order and cut into blocks of equal word
counts, give or take a word: at most ``BLOCK_WORDS``, and so short that ``MIN_SLOTS`` are
due, as the schedule deals a source a few slots more or less.  Slot j of the schedule maps the
golden-ratio point frac(j * phi) through the cumulative slots due to a source, which are its
target by the mean length of its blocks, and the k-th slot of a source takes its block
k mod n, so a source is gone through again only after all its blocks were used.

Sources are rows, however many there are: they are numbered by a sort, targets come from
sums over them, and points meet their source in an equi-join on cells of the cumulative
slots.  Ranks are counted within chunks of slots, positions within a source over hashed
buckets of about ``BUCKET_DOCS`` documents; both start from sums over what comes before,
never from one window over a whole source.  Slots due are whole multiples of 2**-16, so
that sums do not depend on their order and reruns agree.

Sizes are words of the text (null: 0).  Null sources are one source, the last.  Documents
without words lie in no block and are taken 0 times; repeated rows count as often as they
occur; an empty table has an empty mix; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.llm import common, scan

#: Fixed by the contract.
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3

BLOCK_WORDS = 128
MIN_SLOTS = 128  # due to a source whose target has as many words
SPARE_SLOTS = 4  # of a source at its limit: the schedule may deal it fewer than are due
CHUNK_SLOTS = 1 << 14
BUCKET_DOCS = 1024
DUE_UNIT = 1 << 16
_PHI = np.uint64(0x9E3779B97F4A7C15)  # 2**64 / golden ratio


def _before(*by: str, order: str):
    """Rows that come before within ``by``."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, the row's identity, size: the words of each row's text."""

    def rows(batch):
        for s in scan.slices(batch["text"]):
            same = batch.slice(s.first, len(s))
            yield {c: same[c] for c in ("doc_id", "source", *common.ROW)} | {"size": s.words().counts}

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *common.row_id(), F.col("text").cast("string"))
    return common.arrow_map(narrow, rows, "doc_id long, source string, _doc long, _key long, size long")


def copies(sized: DataFrame) -> DataFrame:
    """``sized`` (staged, with _row) with _copy: rows of one identity numbered from 0.

    They are numbered within the parts they were written in, and parts by what is before
    them, so no task gathers the rows of one identity.
    """
    part = F.shiftright("_row", 33)
    several = common.stage(sized.groupBy(*common.ROW, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_several", F.sum("_n").over(Window.partitionBy(*common.ROW))).where(F.col("_several") > 1), "copies")
    base = several.select(*common.ROW, "_part", F.coalesce(F.sum("_n").over(_before(*common.ROW, order="_part")), F.lit(0)).alias("_base"))
    base = common.small(common.stage(base, "copies-before"))
    ids = common.small(several.select(*common.ROW).distinct())
    again = sized.join(ids, common.ROW, "left_semi").withColumn("_part", part)
    again = again.withColumn("_copy", F.row_number().over(Window.partitionBy(*common.ROW, "_part").orderBy("_row")) - 1).join(base, [*common.ROW, "_part"])
    again = again.select(*sized.columns, (F.col("_copy") + F.col("_base")).cast("long").alias("_copy"))
    return sized.join(ids, common.ROW, "left_anti").withColumn("_copy", F.lit(0).cast("long")).unionByName(again)


def _sum_before(placed: DataFrame, value: str, name: str) -> DataFrame:
    """``placed`` (staged in order, _place by monotonically_increasing_id) with the sum of ``value`` over all earlier rows."""
    part = placed.withColumn("_part", F.shiftright("_place", 33))
    whole = part.groupBy("_part").agg(F.sum(value).alias("_whole"))  # one row for each part of the sort
    base = whole.select("_part", F.coalesce(F.sum("_whole").over(_before(F.lit(0), order="_part")), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(_before("_part", order="_place")), F.lit(0))
    return part.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + within).cast("long")).drop("_part", "_base")


def share_unit(sources: DataFrame, most_times: int = MOST_TIMES) -> float:
    """Words due for a weight of one: the sum of sizes by weight, none over ``most_times`` its size, the excess shared again.

    Each turn is a sum over the sources at the last unit; the unit only rises, so a source
    that is at its limit stays there.
    """
    unit = 0.0
    while True:
        capped = F.lit(unit) * F.col("weight") > most_times * F.col("source_size")
        left, weight = sources.agg(F.sum(F.col("source_size") - F.when(capped, most_times * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        found = left / weight if weight else unit
        if found <= unit:
            return unit
        unit = found


def targets(sources: DataFrame, most_times: int = MOST_TIMES) -> DataFrame:
    """``sources`` (source_size, weight) with their target."""
    most = most_times * F.col("source_size")
    return sources.withColumn("target", F.least(most.cast("double"), F.lit(share_unit(sources, most_times)) * F.col("weight")))


def sources_of(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One staged row per source: _source (its number), size, target, blocks, buckets and its place [_low, _high) among the slots due."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    placed = common.stage(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("_place", F.monotonically_increasing_id()).withColumn("_one", F.lit(1)), "sources")
    numbered = common.stage(_sum_before(placed, "_one", "_source"), "numbered-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_source") % len(WEIGHTS) + 1).cast("int"))
    found = targets(numbered.withColumn("weight", weight))
    fine = F.ceil(MIN_SLOTS * F.col("source_size") / F.greatest("target", F.lit(1.0)))
    blocks = F.least("source_size", F.greatest(F.expr(f"(source_size + {block_words - 1}) div {block_words}"), fine))
    found = found.withColumn("blocks", blocks).withColumn("buckets", F.expr(f"(_docs + {BUCKET_DOCS - 1}) div {BUCKET_DOCS}"))
    due = F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1)) + F.when((F.col("blocks") > 0) & (F.col("target") >= MOST_TIMES * F.col("source_size")), SPARE_SLOTS).otherwise(0)
    found = common.stage(found.withColumn("_due", F.ceil(due * DUE_UNIT)), "sources-due")
    found = _sum_before(found, "_due", "_low").withColumn("_high", F.col("_low") + F.col("_due"))
    return common.stage(found.drop("_place", "_one", "_docs", "_due", "weight"), "sources-placed")


def schedule(sources: DataFrame) -> DataFrame:
    """slot, _source, rank: each slot's source and its rank among that source's slots."""
    spark = sources.sparkSession
    due, n = sources.agg(F.coalesce(F.max("_high"), F.lit(0)), F.count(F.lit(1))).first()
    slots = -(-due // DUE_UNIT)
    width = max(1, -(-due // max(1, n)))

    def points(batch):
        for number in batch["id"].to_pylist():
            j = np.arange(number * CHUNK_SLOTS, min(slots, (number + 1) * CHUNK_SLOTS), dtype=np.uint64)
            yield {"slot": j, "_point": np.minimum((((j * _PHI) >> np.uint64(11)) * 2.0**-53 * due).astype(np.int64), due - 1)}

    cells = sources.where(F.col("_high") > F.col("_low")).select("_source", "_low", "_high", F.explode(F.expr(f"sequence(_low div {width}, (_high - 1) div {width})")).alias("_cell"))
    cells = common.small(common.stage(cells, "cells"))
    slot = common.arrow_map(spark.range(-(-slots // CHUNK_SLOTS)), points, "slot long, _point long").withColumn("_cell", F.expr(f"_point div {width}"))
    slot = slot.join(cells, "_cell").where((F.col("_low") <= F.col("_point")) & (F.col("_point") < F.col("_high")))
    slot = common.stage(slot.select("slot", F.expr(f"slot div {CHUNK_SLOTS}").alias("_chunk"), "_source"), "slots")
    base = slot.groupBy("_chunk", "_source").agg(F.count(F.lit(1)).alias("n")).select("_chunk", "_source", F.coalesce(F.sum("n").over(_before("_source", order="_chunk")), F.lit(0)).alias("_base"))
    base = common.small(common.stage(base, "slot-ranks"))
    within = F.row_number().over(Window.partitionBy("_chunk", "_source").orderBy("slot")) - 1
    return slot.withColumn("_within", within).join(base, ["_chunk", "_source"]).select("slot", "_source", (F.col("_base") + F.col("_within")).alias("rank"))


def prepare(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents (with _row), where those with words lie in their source, and the sources."""
    # the number is staged with the row, so that it holds from here on
    sized = common.stage(word_counts(docs).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    sources = sources_of(sized, block_words)
    table = common.small(sources.drop("_low", "_high").withColumnRenamed("source", "_name"))
    sized = sized.join(table, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")

    # copies of a row are told apart by their number, so that an order over them is the same each time
    filled = copies(sized.where(F.col("size") > 0).select("_row", *common.ROW, "size", "_source", "buckets", "source_size", "blocks"))
    filled = filled.withColumn("_order", F.xxhash64(*common.ROW, "_copy")).withColumn("_bucket", F.pmod(F.col("_order"), F.col("buckets")))
    buckets = filled.groupBy("_source", "_bucket").agg(F.sum("size").alias("n")).select("_source", "_bucket", F.coalesce(F.sum("n").over(_before("_source", order="_bucket")), F.lit(0)).alias("_opens"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", *common.ROW, "_copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = filled.join(common.small(common.stage(buckets, "buckets")), ["_source", "_bucket"]).withColumn("_at", F.col("_opens") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return sized, placed.select("_row", "_source", "size", "_at", "source_size", "blocks"), sources


def parts(placed: DataFrame) -> DataFrame:
    """_row, _source, _block, word_start, n_words: placed documents by block, as far as blocks are ``_used``."""
    # block b opens at word b * source_size div blocks, so that the longer ones are spread evenly; products can pass 64 bits
    wide = lambda x: f"CAST({x} AS DECIMAL(19, 0))"
    block = lambda at: F.expr(f"({wide(f'{at} + 1')} * {wide('blocks')} - 1) div source_size")
    opens = lambda b: F.expr(f"({wide(b)} * {wide('source_size')}) div blocks")
    cut = placed.withColumn("_first", block("_at")).where(F.col("_first") < F.col("_used"))
    cut = cut.withColumn("_block", F.explode(F.sequence("_first", F.least(block("_at + size - 1"), F.col("_used") - 1))))
    begin, end = F.greatest(F.col("_at"), opens("_block")), F.least(F.col("_at") + F.col("size"), opens("_block + 1"))
    return cut.select("_row", "_source", "_block", (begin - F.col("_at")).alias("word_start"), (end - begin).alias("n_words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Sized documents, and the mix: one row per slot and document part in it.

    Columns of the mix: slot, epoch, _source, _block, _row (of the sized documents), word_start, n_words.
    """
    sized, placed, sources = prepare(docs, block_words)
    slots = common.stage(schedule(sources), "schedule")
    dealt = slots.groupBy("_source").agg(F.count(F.lit(1)).alias("_dealt")).join(sources.select("_source", "blocks"), "_source").where(F.col("blocks") > 0)
    dealt = common.small(common.stage(dealt.select("_source", F.col("blocks").alias("_blocks"), F.least("blocks", "_dealt").alias("_used")), "dealt"))
    used = slots.join(dealt, "_source").withColumn("epoch", F.expr("rank div _blocks")).withColumn("_block", F.col("rank") % F.col("_blocks"))
    # a source at its limit is dealt spare slots: its blocks are used up then
    used = used.where(F.col("epoch") < MOST_TIMES)
    cut = parts(placed.join(dealt.drop("_blocks"), "_source"))
    return sized, used.join(cut, ["_source", "_block"]).select("slot", "epoch", "_source", "_block", "_row", "word_start", "n_words")


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row's identity, size, its source's size and target, and the words the mix takes of it (staged)."""
    with common.scratch(docs.sparkSession):
        sized, mixed = mix(docs, block_words)
        words = mixed.groupBy("_row").agg(F.sum("n_words").alias("_taken"))
        found = sized.join(words, "_row", "left").select("doc_id", *common.ROW, "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
        return common.stage(found, "taken", keep=True)


def repeat(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the mix takes all of it.

    What the mix takes beyond that are a row's first words, as blocks are used in order; they
    come as one more document, n_chars to match, so that every source has the words it takes.
    Nulls in other columns stay; rows without words do not come; repeated rows share evenly
    what the mix takes of them; columns may have any names.
    """
    each = taken(docs, block_words).where(F.col("size") > 0).groupBy(*common.ROW).agg(F.expr("sum(taken) div count(1)").alias("_each"), F.max("size").alias("_size"))
    times = common.stage(each.where(F.col("_each") > 0).select(*common.ROW, F.expr("_each div _size").cast("int").alias("_times"), (F.col("_each") % F.col("_size")).alias("_rest")), "times")
    text, n_chars = (f"_column_{docs.columns.index(c)}" if c in docs.columns else None for c in ("text", "n_chars"))
    lengths = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("_times")), F.when(F.col("_rest") > 0, F.array("_rest")).otherwise(F.array().cast("array<long>")))
    repeated = common.coded(docs).join(common.small(times), common.ROW).withColumn("_words", F.explode(lengths))
    cut = F.col("_words") >= 0
    words = F.regexp_extract_all(F.col(text).cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    repeated = repeated.withColumn(text, F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), "")).otherwise(F.col(text)))
    if n_chars:
        repeated = repeated.withColumn(n_chars, F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return common.decoded(repeated, docs)
