"""N-gram Jaccard join: exact links at 0.75 by token-combination prefixes.

Tokens are distinct 5-word shingles, as 64-bit hashes.  Documents with equal sets form a
class and one representative stands for it, so copies are never expanded into pairs.

1. ``token_counts``: in how many rows each token occurs.  Tokens travel packed in binary
   blobs by hash range, four bytes each; texts do not move.  More than a quarter of tokens
   of its own leaves a representative without any partner: it drops out here, exactly.
2. ``signatures``: tokens are ordered rare first.  A prefix takes tokens until more than a
   quarter of the set must miss for a partner to share nothing of it.  Rare tokens are
   indexed one by one.  Frequent ones, by hashed subclasses, in combinations of two: a
   subclass of c tokens covers c - 1 misses, so the prefix is extended by one token for
   each subclass.  Partners share a signature whatever else differs.
3. ``link``: in each signature's bucket candidates are verified against a hub, then against
   another member of the hub's component.  Buckets inside one component need no more pairs,
   which is what keeps a group of thousands of near copies from being squared.  Where
   different components still meet, all pairs are tried whose sizes and own tokens allow a
   link, and only those become rows whose bitmaps do not prove that they differ too much.

Empty texts have no set and no links; texts of fewer than five words have one token, the
whole sequence.  Repeated rows fall into one class; a null doc_id never is a component's
id unless all are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, scan

SHINGLE = 5
#: Tokens in this many representatives or more are frequent; more of them than ``DICTIONARY`` raise it.
FREQUENT = 64
DICTIONARY = 1 << 20
RANGE_TOKENS = 1 << 21
#: From this set size on frequent tokens are combined.
COMBINE_FROM = 16
#: Size of the bitmap that bounds in how many tokens two sets differ.
BITMAP_BITS = 1024
BITMAP = [f"x{i}" for i in range(BITMAP_BITS // 64)]
#: Ratio of the sizes that share a cell at most.
CELL_STEP = 1.03


def token_sets(s: scan.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct tokens in ascending order, and their offsets."""
    words = s.lower().words()
    codes = words.hashes()
    starts = np.flatnonzero(scan.whole_windows(words.offsets, SHINGLE, len(words)))
    tokens, owner = scan.folded_windows(codes, SHINGLE)[starts], np.searchsorted(words.offsets, starts, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    whole = words.counts[short].astype(np.uint64)
    for i in range(SHINGLE - 1):
        more = words.counts[short] > i
        whole[more] = scan.fold(whole[more], codes[words.offsets[short[more]] + i])
    tokens = np.concatenate([tokens, whole])
    owner = np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))[: len(tokens)]
    tokens, owner = tokens[fresh], owner[fresh]
    return tokens, np.searchsorted(owner, np.arange(len(s) + 1))


def sets(docs: DataFrame) -> DataFrame:
    """The row's identity, doc_id, n, c0, c1: size and 128-bit identity of each row's token set."""

    def rows(batch):
        for s in scan.slices(batch["text"]):
            tokens, at = token_sets(s)
            out = {c: batch[c].slice(s.first, len(s)) for c in ("doc_id", *common.ROW)} | {"n": np.diff(at)}
            for name, salt in (("c0", 0x51), ("c1", 0xA7)):
                total = np.zeros(len(tokens) + 1, np.uint64)
                np.cumsum(scan.mix(tokens ^ np.uint64(salt)), out=total[1:])
                out[name] = total[at[1:]] - total[at[:-1]]
            yield out

    return common.arrow_map(_keyed(docs), rows, "_doc long, _key long, doc_id long, n long, c0 long, c1 long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), *common.row_id(), F.col("text").cast("string"))


def _texts_of(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """id and text of each row of ``numbered``, in an order that a rerun repeats."""
    near = common.fits(numbered)
    keyed = _keyed(docs)
    found = keyed.join(F.broadcast(numbered), common.ROW) if near else common.thin(keyed, numbered, common.ROW).join(numbered, common.ROW)
    return (found if near else found.sortWithinPartitions(*common.ROW)).dropDuplicates(["id"]).select("id", "text")


def _pack_owners(owner: np.ndarray) -> bytes:
    """Ascending row numbers as the steps between the different ones and how often each occurs, in one byte or four."""
    who, many = np.unique(owner, return_counts=True)
    steps = np.diff(who, prepend=0)
    width = np.uint8 if max(steps.max(initial=0), many.max(initial=0)) < 256 else np.uint32
    return bytes([np.dtype(width).itemsize]) + np.stack([steps, many]).astype(width).tobytes()


def _unpack_owners(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, many = np.frombuffer(packed, np.uint8 if packed[0] == 1 else np.uint32, offset=1).astype(np.int64).reshape(2, -1)
    return np.cumsum(steps), many


def token_counts(texts: DataFrame, total: int) -> DataFrame:
    """Staged rows of two kinds: per slice of documents, keys and own-token counts by range;
    per range, frequent tokens (the top bits of their hash) with counts.

    A token that occurs in several texts of a slice leaves it once, with its count, so that
    tokens which stand in a large share of all texts do not gather in one range's task.
    """
    bits = max(6, (max(1, total) // RANGE_TOKENS).bit_length())
    ranges = 1 << bits

    def deal(batch):
        for s in scan.slices(batch["text"], 1 << 20):
            tokens, at = token_sets(s)
            n, owner = len(s), np.repeat(np.arange(len(s)), np.diff(at))
            order = np.argsort(tokens, kind="stable")
            opens = np.flatnonzero(np.append(True, tokens[order][1:] != tokens[order][:-1]))[: len(tokens)]
            many = np.diff(np.append(opens, len(tokens)))
            several, times = tokens[order[opens[many > 1]]], many[many > 1].astype(np.uint32)
            once = np.zeros(len(tokens), bool)
            once[order[opens[many == 1]]] = True
            tokens, owner = tokens[once], owner[once]
            top = np.uint64(64 - bits)
            # a row for each range that the slice has tokens of; the first one carries the slice's keys
            used = np.unique(np.concatenate([[np.uint64(0)], tokens >> top, several >> top]))
            edges = np.searchsorted(several >> top, np.append(used, np.uint64(ranges))).tolist()
            several = (several >> np.uint64(32 - bits)).astype(np.uint32)
            order = np.argsort((tokens >> top) * np.uint64(n) + owner.astype(np.uint64), kind="stable")
            ends = np.searchsorted((tokens >> top)[order], np.append(used, np.uint64(ranges))).tolist()
            low, owner = (tokens[order] >> np.uint64(32 - bits)).astype(np.uint32), owner[order].astype(np.uint32)
            keys = np.stack([batch[c].slice(s.first, n).to_numpy() for c in common.ROW], axis=1)
            yield {
                "range": used.astype(np.int32),
                "slice": np.full(len(used), xxhash.xxh3_64_intdigest(keys.tobytes()), np.uint64),
                "keys": [keys.tobytes()] + [None] * (len(used) - 1),
                "owners": [_pack_owners(owner[a:b]) for a, b in pairwise(ends)],
                "tokens": [low[a:b].tobytes() for a, b in pairwise(ends)],
                "several": [several[a:b].tobytes() for a, b in pairwise(edges)],
                "times": [times[a:b].tobytes() for a, b in pairwise(edges)],
            }

    def count(key, table):
        blobs = [np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()]
        owners = [_unpack_owners(x) for x in table["owners"].to_pylist()]
        tokens = np.concatenate(blobs + [np.frombuffer(x, np.uint32) for x in table["several"].to_pylist()])
        times = np.concatenate([np.frombuffer(x, np.uint32) for x in table["times"].to_pylist()])
        order = np.argsort(tokens, kind="stable")
        opens = np.flatnonzero(np.append(True, tokens[order][1:] != tokens[order][:-1]))[: len(tokens)]
        times = np.append(np.ones(len(tokens) - len(times), np.int64), times)
        many = np.add.reduceat(times[order], opens) if len(tokens) else times
        alone = np.zeros(len(tokens) + 1, np.int64)
        alone[order[opens[many == 1]] + 1] = 1
        alone = np.cumsum(alone)
        own, at = [], 0
        for who, each in owners:
            ends = at + np.cumsum(each)
            found = alone[ends] - alone[ends - each]
            own.append(np.stack([who[found > 0], found[found > 0]]).astype(np.uint32).tobytes())
            at += int(each.sum())
        often = many >= FREQUENT
        frequent = (np.uint64(key[0].as_py()) << np.uint64(32)) | tokens[order[opens[often]]].astype(np.uint64)
        return pa.table({
            "slice": pa.array([*table["slice"].to_pylist(), None], pa.int64()),
            "keys": pa.array([*table["keys"].to_pylist(), None], pa.binary()),
            "own": pa.array([*own, None], pa.binary()),
            "tokens": pa.array([None] * len(own) + [frequent.tobytes()], pa.binary()),
            "often": pa.array([None] * len(own) + [many[often].astype(np.int64).tobytes()], pa.binary()),
            "bits": pa.array([bits] * (len(own) + 1), pa.int32()),
        })

    dealt = common.arrow_map(texts, deal, "range int, slice long, keys binary, owners binary, tokens binary, several binary, times binary")
    return common.stage(dealt.groupBy("range").applyInArrow(count, "slice long, keys binary, own binary, tokens binary, often binary, bits int"), "token-counts")


def own_tokens(counted: DataFrame) -> DataFrame:
    """_doc, _key, own: how many tokens only this row has."""

    def add(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(next(x for x in table["keys"].to_pylist() if x is not None), np.int64).reshape(-1, 2)
        own = np.zeros(len(keys), np.int64)
        for packed in table["own"].to_pylist():
            who, many = np.frombuffer(packed, np.uint32).reshape(2, -1)
            own[who] += many  # each row once
        return pa.table({"_doc": keys[:, 0], "_key": keys[:, 1], "own": own})

    return counted.where(F.col("slice").isNotNull()).select("slice", "keys", "own").groupBy("slice").applyInArrow(add, "_doc long, _key long, own long")


def dictionary(counted: DataFrame) -> tuple[np.ndarray, int]:
    """The frequent tokens, at most ``DICTIONARY`` of them, and how many bits they have.

    Their numbers by powers of two of the count decide from which count on a token is
    frequent, before any token comes to the driver; which tokens count as frequent
    changes the work, never the links.
    """

    def histogram(batch):
        for often, bits in zip(batch["often"].to_pylist(), batch["bits"].to_pylist(), strict=True):
            level = np.bincount(np.log2(np.frombuffer(often, np.int64)).astype(int), minlength=1)
            yield {"level": np.arange(len(level)), "n": level, "bits": np.full(len(level), bits, np.int32)}

    listed = counted.where(F.col("tokens").isNotNull()).select("tokens", "often", "bits")
    levels = common.arrow_map(listed, histogram, "level long, n long, bits int").groupBy("level").agg(F.sum("n").alias("n"), F.max("bits").alias("bits")).collect()
    if not levels:
        return np.zeros(0, np.uint64), 6
    floor = 0
    while sum(r["n"] for r in levels if r["level"] >= floor) > DICTIONARY:
        floor += 1

    def pick(batch):
        for tokens, often in zip(batch["tokens"].to_pylist(), batch["often"].to_pylist(), strict=True):
            yield {"tokens": [np.frombuffer(tokens, np.uint64)[np.frombuffer(often, np.int64) >= 2**floor].tobytes()]}

    found = [np.frombuffer(r["tokens"], np.uint64) for r in common.arrow_map(listed.select("tokens", "often"), pick, "tokens binary").collect()]
    return np.sort(np.concatenate(found)), max(r["bits"] for r in levels)


def _pairs_within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of equal (sorted) group numbers."""
    n = len(group)
    ends = np.searchsorted(group, group, "right")
    many = ends - np.arange(n) - 1
    left = np.repeat(np.arange(n), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + left + 1
    return left, right


def prefix_signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of one token set (ascending), of which any partner shares one."""
    n, found = len(tokens), []
    size = n.bit_length() - 1
    # a partner of the next smaller size class combines by that class; so does this set then
    classes = {size, size - 1} if 3 * n < 4 << size else {size}
    order = np.concatenate([np.flatnonzero(~frequent), np.flatnonzero(frequent)])
    for c in classes:
        if c < 0:
            continue
        if 1 << c < COMBINE_FROM:
            found.append(tokens[order[: n // 4 + 1]])
            continue
        subclasses = np.uint64(1 << c >> 2)
        part = scan.mix(tokens) % subclasses
        covers = np.ones(n, np.int64)
        rest = order[n - int(frequent.sum()) :]
        _, firsts = np.unique(part[rest], return_index=True)
        covers[n - len(rest) + firsts] = 0  # the first of a subclass makes no combination yet
        enough = int(np.searchsorted(np.cumsum(covers), n // 4 + 1)) + 1
        prefix = order[:enough]
        rare, often = prefix[~frequent[prefix]], prefix[frequent[prefix]]
        found.append(tokens[rare])
        by = np.argsort(part[often], kind="stable")
        often = often[by]
        left, right = _pairs_within(part[often])
        found.append(scan.mix(tokens[often[left]] * np.uint64(0x9E3779B97F4A7C15) + tokens[often[right]] + np.uint64(c)))
    return np.unique(np.concatenate(found))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """``BITMAP_BITS`` bits in longs: how many tokens fall on each, modulo two."""
    place = (scan.mix(tokens ^ np.uint64(0xB17)) % np.uint64(BITMAP_BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(tokens: DataFrame, scores: DataFrame, frequent: np.ndarray, bits: int) -> DataFrame:
    """sig, id, n, m: the signatures of each surviving representative, out of its packed set."""
    held = tokens.sparkSession.sparkContext.broadcast(frequent)  # at most DICTIONARY tokens of 8 bytes

    def rows(batch):
        known = held.value
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets_ = [np.frombuffer(x, np.uint64) for x in part["tokens"].to_pylist()]
            top = np.concatenate(sets_) >> np.uint64(32 - bits)
            often = known[np.minimum(np.searchsorted(known, top), len(known) - 1)] == top if len(known) else np.zeros(len(top), bool)
            often = np.split(often, np.cumsum([len(x) for x in sets_])[:-1])
            sigs = [prefix_signatures(x, f) for x, f in zip(sets_, often, strict=True)]
            yield {"sig": np.concatenate(sigs), "id": part["id"].take(pa.array(np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])))}

    return common.arrow_map(tokens.select("id", "tokens"), rows, "sig long, id long").join(common.small(scores), "id")


def packed_sets(texts: DataFrame) -> DataFrame:
    """id, tokens, x0, x1, ...: each representative's token set as packed 64-bit integers, and its bitmap."""

    def rows(batch):
        for s in scan.slices(batch["text"]):
            tokens, at = token_sets(s)
            bits = np.stack([bitmap(tokens[a:b]) for a, b in pairwise(at.tolist())])
            yield {"id": batch["id"].slice(s.first, len(s)), "tokens": scan.binary(tokens, at)} | {f"x{i}": bits[:, i] for i in range(BITMAP_BITS // 64)}

    return common.arrow_map(texts, rows, "id long, tokens binary, " + ", ".join(f"{x} long" for x in BITMAP))


def verify(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b), staged before, that link: 100 * intersection >= 75 * union.

    Only the sets that a pair asks for on a side are moved to it.
    """

    def rows(batch):
        a = [np.frombuffer(x, np.uint64) for x in batch["ta"].to_pylist()]
        b = [np.frombuffer(x, np.uint64) for x in batch["tb"].to_pylist()]
        hit = []
        for x, y in zip(a, b, strict=True):
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            hit.append(100 * shared >= 75 * (len(both) - shared))
        yield {c: batch[c].filter(pa.array(hit)) for c in ("a", "b")}

    def asked(side: str) -> DataFrame:
        ids = common.small(common.stage(pairs.select(F.col(side).alias("id")).distinct(), "asked"))
        return tokens.select("id", "tokens").join(ids, "id", "left_semi").select(F.col("id").alias(side), F.col("tokens").alias(f"t{side}"))

    return common.arrow_map(pairs.join(asked("b"), "b").join(asked("a"), "a").select("a", "b", "ta", "tb"), rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, comp: the smallest key that each linked key reaches (staged).

    Wherever the two ends of a link have different labels, the larger label is hooked to
    the smallest one met, and all keys follow the hooks a few steps; labels only ever
    fall and stay within their component, so when no link has two labels they are its
    smallest key.  Each round is one shuffle of labels that still differ.
    """
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    labels = common.stage(ends.select(F.col("a").alias("id"), F.col("a").alias("comp")), "labels")
    while True:
        known = common.small(labels)
        at = {e: known.select(F.col("id").alias(e), F.col("comp").alias(f"{e}_comp")) for e in ("a", "b")}
        apart = links.join(at["a"], "a").join(at["b"], "b").where(F.col("a_comp") != F.col("b_comp"))
        hooks = apart.groupBy(F.greatest("a_comp", "b_comp").alias("_from")).agg(F.min(F.least("a_comp", "b_comp")).alias("_to"))
        hooks = common.stage(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        hooks = common.small(hooks)
        for _ in range(3):
            labels = labels.join(hooks, F.col("comp") == F.col("_from"), "left").select("id", F.coalesce("_to", "comp").alias("comp"))
        labels = common.stage(labels, "labels")


def _first() -> F.Column:
    """Hubs are those with the smallest share of tokens of their own."""
    return F.struct((-F.col("m") / F.col("n")).alias("score"), "id", "n", "m")


def _hub() -> list[F.Column]:
    return [F.col("h.id").alias("hub"), F.col("h.n").alias("n_hub"), F.col("h.m").alias("m_hub")]


def _of_the_hubs_component(placed: DataFrame) -> DataFrame:
    """A partner per bucket from the component of its hub, another one in every bucket.

    A member that the hub itself did not link meets as many of the component as it has
    signatures; in a group of near copies that is enough for nearly all.
    """
    by_chance = F.struct(F.xxhash64("sig", "id").alias("_chance"), "id", "n", "m")
    # hubs come first; of the component, a member by chance
    chosen = placed.groupBy("sig", "comp").agg(F.min(_first()).alias("_first"), F.min(by_chance).alias("h"))
    best = chosen.groupBy("sig").agg(F.min(F.struct("_first", "comp", "h")).alias("b"))
    return best.select("sig", F.col("b.h.id").alias("hub"), F.col("b.h.n").alias("n_hub"), F.col("b.h.m").alias("m_hub"), F.col("b.comp").alias("hub_comp"))


def _cell(n: F.Column) -> F.Column:
    """Sizes in steps of ``CELL_STEP``: the cell that a size falls in."""
    return F.floor(F.log(n.cast("double")) / math.log(CELL_STEP)).cast("int")


def _apart(placed: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """a, b: all pairs of a bucket in different components that may still link.

    A set meets only partners of a size that could link with it: no larger than itself, no
    smaller than three quarters, and small enough that the tokens which are not its own
    suffice.  Sizes come in cells beside the signature, and cells that a bucket lacks are
    left out first.  So documents that share a template and little else, whose own tokens
    rule each other out, are never compared, however many they are.

    Sets that link differ in no more than a seventh of their sizes' sum, and their bitmaps
    in no more bits than the sets in tokens.  Nearly all pairs that share many shingles
    without reaching 0.75 fail that test within the join and never become rows.
    """
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    low, high = F.floor((3 * n + 3) / 4), F.least(n, F.floor((7 * m - 3 * n) / 3))
    probing = placed.where((low <= high) & (high > 0)).withColumn("cell", F.explode(F.sequence(_cell(low), _cell(high))))
    celled = placed.withColumn("cell", _cell(n))
    probing = probing.join(celled.select("sig", "cell").distinct(), ["sig", "cell"], "left_semi").join(bitmaps, "id")
    held = celled.join(bitmaps, "id")
    held = held.select("sig", "cell", *[F.col(c).alias(f"{c}_hub") for c in held.columns if c not in ("sig", "cell")])
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_hub"))) for x in BITMAP[1:]), F.bit_count(F.col(BITMAP[0]).bitwiseXOR(F.col(f"{BITMAP[0]}_hub"))))
    smaller = (F.col("n_hub") < F.col("n")) | ((F.col("n_hub") == F.col("n")) & (F.col("id_hub") < F.col("id")))
    may = (F.col("comp") != F.col("comp_hub")) & smaller & _near() & (differ * 7 <= F.col("n") + F.col("n_hub"))
    return probing.join(held, ["sig", "cell"]).where(may).select(F.least("id", "id_hub").alias("a"), F.greatest("id", "id_hub").alias("b")).distinct()


def _near() -> F.Column:
    """4 * intersection >= 3 * union, and no more can be shared than what is not a set's own."""
    return F.least("m", "m_hub") * 7 >= (F.col("n") + F.col("n_hub")) * 3


def link(sigs: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links found between representatives (staged), and (id, comp) of those linked."""
    shared = common.stage(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > 1).select("sig"), "shared-signatures")
    held = common.stage(sigs.join(common.small(shared), "sig", "left_semi"), "signatures")
    pair = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]

    hubs = common.stage(held.groupBy("sig").agg(F.min(_first()).alias("h")).select("sig", *_hub()), "hubs")
    tried = common.stage(held.join(common.small(hubs), "sig").where((F.col("id") != F.col("hub")) & _near()).select(*pair).distinct(), "pairs")
    links = common.stage(verify(tried, tokens), "links")
    comps = components(links)

    for last in (False, True):
        # members of buckets in which different components meet
        placed = common.stage(held.join(common.small(comps), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")
        open_ = common.stage(placed.groupBy("sig").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where(F.col("_a") != F.col("_b")).select("sig"), "open-signatures")
        if open_.isEmpty():
            break
        open_ = common.small(open_)
        held, placed = (x.join(open_, "sig", "left_semi") for x in (placed.drop("comp"), placed))
        if last:
            pairs = _apart(placed, tokens.select("id", *BITMAP))
        else:
            others = common.small(common.stage(_of_the_hubs_component(placed), "partners"))
            pairs = placed.join(others, "sig").where((F.col("comp") != F.col("hub_comp")) & _near()).select(*pair).distinct()
        pairs = common.stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        links = common.stage(links.unionByName(verify(pairs, tokens)), "links")
        comps = components(links)
    return links, comps


def join(docs: DataFrame) -> DataFrame:
    """_doc, _key, doc_id, n_shingles, class_id, component_id, first_doc, first_key: one row per row of ``docs``.

    ``first_doc`` and ``first_key`` are the row that stays of its component: the smallest doc_id.
    """
    with common.scratch(docs.sparkSession):
        return common.stage(_join(docs), "joined", keep=True)


def _join(docs: DataFrame) -> DataFrame:
    measured = common.stage(sets(docs), "token-sets")
    filled = measured.where(F.col("n") > 0)
    classes = filled.groupBy("c0", "c1").agg(F.min(F.struct("_doc", "_key", "doc_id")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    # the number is staged with the class, so that it holds from here on
    classes = common.stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    reps = classes.select("id", "first._doc", "first._key", "n", "rows")
    total = filled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = token_counts(_keyed(docs), total)
    # tokens are counted over all rows: a class of several copies has none that occurs once
    own = F.when(F.col("rows") == 1, F.col("own")).otherwise(0)
    scores = own_tokens(counted).join(reps, common.ROW).where(own <= F.floor(F.col("n") / 4)).select("id", *common.ROW, F.col("n").cast("int"), (F.col("n") - own).cast("int").alias("m")).dropDuplicates(["id"])
    scores = common.stage(scores, "survivors")
    texts = _texts_of(docs, scores.select("id", *common.ROW))
    frequent, bits = dictionary(counted)
    tokens = common.stage(packed_sets(texts), "packed-sets")
    _, comps = link(signatures(tokens, scores.select("id", "n", "m"), frequent, bits), tokens)

    labelled = classes.join(common.small(comps), "id", "left").select("c0", "c1", "id", "first", F.coalesce("comp", "id").alias("comp"))
    labelled = common.stage(labelled, "labelled")
    lowest = common.stage(labelled.groupBy("comp").agg(F.min("first").alias("lowest")), "lowest")
    labelled = labelled.join(common.small(lowest), "comp").select("c0", "c1", F.col("id").alias("class_id"), F.col("lowest.doc_id").alias("component_id"), F.col("lowest._doc").alias("first_doc"), F.col("lowest._key").alias("first_key"))
    labelled = common.small(common.stage(labelled, "components"))
    own_row = [*common.ROW, "doc_id", F.col("n").alias("n_shingles")]
    alone = measured.where(F.col("n") == 0).select(*own_row, F.lit(None).cast("long").alias("class_id"), F.col("doc_id").alias("component_id"), F.col("_doc").alias("first_doc"), F.col("_key").alias("first_key"))
    return filled.join(labelled, ["c0", "c1"]).select(*own_row, "class_id", "component_id", "first_doc", "first_key").unionByName(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id."""
    staying = join(docs).where((F.col("_doc") == F.col("first_doc")) & (F.col("_key") == F.col("first_key"))).groupBy(*common.ROW).agg(F.count(F.lit(1)).alias("_rows"))
    staying = common.stage(staying, "staying")
    kept = common.coded(docs).join(common.small(staying), common.ROW)
    once = kept.where(F.col("_rows") == 1)
    if not staying.where(F.col("_rows") > 1).isEmpty():
        once = once.unionByName(kept.where(F.col("_rows") > 1).dropDuplicates(common.ROW))
    return common.decoded(once, docs)
