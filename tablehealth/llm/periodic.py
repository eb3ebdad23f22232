"""Runs of periodic words: a suffix automaton whose link tree is a link-cut tree.

Each appended word adds a state; an access recolours the path from that state to the root
with the word's position.  A segment of the path that had one colour so far says where its
longest string last ended: at distance p, with a length of l, the last l + p words have the
period p, and no word before them continues it.  Where l is p or more this is a square;
segments of at least three periods whose next word breaks the period are the runs looked for.

The automaton walks only stretches that can hold a run.  In a run of period q all three-word
windows but the first q words' occur again within q words, so a stretch of m such windows in
a row can only hold periods up to (m + 2) / 3; windows that recur at a greater distance leave
their stretch, until nothing changes.  That is a necessary condition, so no run is lost.

Null and empty texts have no words and no runs.  A text is taken whole, however long; memory
grows with its longest stretch.  Repeated rows and null ids come out row by row, an empty
table gives no rows, and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, scan

#: Fixed by the contract: a run is at least this long, in words and in periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words of the windows that pick stretches; runs of LEAST_WORDS words hold three of them that recur.
_GRAM = 3

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Automaton:
    """Suffix automaton over whole numbers, with the last end of every state's strings."""

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]
        # the link tree's paths of one colour, as splay trees by length; the parent of a splay tree's root is the path's parent
        self.left, self.right, self.parent, self.colour = [-1], [-1], [-1], [-1]
        self.last = 0

    def _state(self, length: int, link: int, edges: dict, colour: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        self.left.append(-1)
        self.right.append(-1)
        self.parent.append(link)
        self.colour.append(colour)
        return len(self.length) - 1

    def append(self, symbol: int, position: int) -> list[tuple[int, int]]:
        """Take one more symbol; of each segment recoloured, where its strings last ended and the longest one's length."""
        length, link, edges = self.length, self.link, self.next
        p = self.last
        new = self._state(length[p] + 1, 0, {}, -1)
        while p >= 0 and symbol not in edges[p]:
            edges[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = edges[p][symbol]
            if length[p] + 1 != length[q]:
                q = self._clone(p, q, symbol)
            link[new] = self.parent[new] = q
        self.last = new
        return self._access(new, position)

    def _clone(self, p: int, q: int, symbol: int) -> int:
        """A state for the shorter strings of q, above q in the link tree and of its colour."""
        self._splay(q)
        top = self.left[q]
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), -1)
        self.parent[c], self.left[c], self.left[q] = q, top, c
        if top >= 0:
            self.parent[top] = c
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def _access(self, node: int, position: int) -> list[tuple[int, int]]:
        left, right, parent, colour, length = self.left, self.right, self.parent, self.colour, self.length
        found, below, x = [], -1, node
        while x >= 0:
            if left[x] >= 0 or right[x] >= 0 or self._inner(x):
                self._splay(x)
            if colour[x] >= 0:
                found.append((colour[x], length[x]))
            deeper = right[x]
            if deeper >= 0:  # what lies below keeps its colour, as a path of its own
                colour[deeper] = colour[x]
            right[x] = below
            below, x = x, parent[x]
        colour[below] = position  # the root of the splay tree that holds the whole path
        return found

    def _inner(self, x: int) -> bool:
        """Is x below another node of its own splay tree."""
        p = self.parent[x]
        return p >= 0 and (self.left[p] == x or self.right[p] == x)

    def _splay(self, x: int) -> None:
        """Make x the root of its splay tree; the colour goes with the root."""
        left, right, parent = self.left, self.right, self.parent
        while True:
            p = parent[x]
            if p < 0 or left[p] != x and right[p] != x:
                return
            g = parent[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self.colour[x] = self.colour[g]  # the right one if g was the root; else a later turn puts it right
                self._rotate(p if (left[p] == x) == (left[g] == p) else x)
                self._rotate(x)
            else:
                self.colour[x] = self.colour[p]
                self._rotate(x)

    def _rotate(self, x: int) -> None:
        left, right, parent = self.left, self.right, self.parent
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            child = right[x]
            left[p], right[x] = child, p
        else:
            child = left[x]
            right[p], left[x] = child, p
        if child >= 0:
            parent[child] = p
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        parent[p], parent[x] = x, g


def runs(symbols: list[int]) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run, by start and then period."""
    automaton, out, n = Automaton(), [], len(symbols)
    for i, symbol in enumerate(symbols):
        for j, length in automaton.append(symbol, i):
            p = i - j
            if length >= (LEAST_PERIODS - 1) * p and length + p >= LEAST_WORDS and (i + 1 == n or symbols[i + 1] != symbols[i + 1 - p]):
                out.append((i - length - p + 1, length + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: scan.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every stretch that may hold runs, with all that its runs could touch; none overlap."""
    none = np.zeros(0, np.int64)
    n = len(words) - _GRAM + 1
    if n < LEAST_WORDS - _GRAM:
        return none, none
    grams = scan.folded_windows(hashes, _GRAM)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)[:n]
    grams = scan.mix(grams + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    distance = np.zeros(n, np.int64)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    distance[~scan.whole_windows(words.offsets, _GRAM, len(words))] = 0
    at = np.flatnonzero(distance)
    while len(at):
        # the same document's windows in a row; a window that crosses documents is never among them
        breaks = np.flatnonzero(np.diff(at) != 1)
        first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(at) - 1]])
        most = (last - first + _GRAM) // 3
        most[last - first + 1 < LEAST_WORDS - _GRAM] = 0
        stay = distance[at] <= np.repeat(most, last - first + 1)
        if stay.all():
            break
        at = at[stay]
    if not len(at):
        return none, none
    # A run begins at most one period before its stretch; a word more on either side tells where it ends.
    own = owner[at[first]]
    begin = np.maximum(at[first] - most - 1, words.offsets[own])
    end = np.minimum(at[last] + _GRAM + 1, words.offsets[own + 1])
    order = np.argsort(begin, kind="stable")  # documents stay in order, stretches of one may change places
    begin, end, own = begin[order], end[order], own[order]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] >= np.maximum.accumulate(end)[:-1]) | (own[1:] != own[:-1])
    groups = np.flatnonzero(fresh)
    return begin[groups], np.maximum.reduceat(end, groups)


def find(s: scan.Slice) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each document of a slice."""
    words = s.words()
    begin, end = stretches(words, words.hashes())
    raw, found = s.data.tobytes(), {}
    first, last, offsets = words.start, words.end, words.offsets
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        numbers: dict[bytes, int] = {}
        symbols = [numbers.setdefault(raw[x:y], len(numbers)) for x, y in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)]
        doc = int(np.searchsorted(offsets, a, "right")) - 1
        base = a - int(offsets[doc])
        found.setdefault(doc, []).extend((x + base, n, p) for x, n, p in runs(symbols))
    out = []
    for doc in range(len(s)):
        text = raw[s.offsets[doc] : s.offsets[doc + 1]].split()
        own = sorted(found.get(doc, ()), key=lambda r: (r[0], r[2]))
        out.append((len(text), own, b" ".join(_kept(text, own))))
    return out


def _kept(words: list[bytes], own: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not own:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in own:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, number of words, all runs by start and period, and the text with each run's repeats left out."""

    def rows(batch):
        for s in scan.slices(batch["text"]):
            done = find(s)
            yield {
                "doc_id": batch["doc_id"].slice(s.first, len(s)),
                "n_words": [n for n, _, _ in done],
                "runs": [[{"start": a, "length": b, "period": c} for a, b, c in own] for _, own, _ in done],
                "collapsed": [text.decode() for _, _, text in done],
            }

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, RUNS)


def digest(collapsed: DataFrame) -> DataFrame:
    """Digests of ``collapse``'s rows: the run of the greatest exponent, and checksums of all runs and of the text left."""
    wider = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, r: F.when(wider(r, a) > 0, r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.col("_best")
    return collapsed.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id and text, with known periodic endings in a tenth of them.

    With h the crc32 of the decimal doc_id and g = h // 10, a document of n > 0 words whose h
    ends in 0 repeats, from word a = g % n on, the 1 + (n - a) // (3 + g % 8) words there.
    Its words are then parted by single spaces; a null doc_id has no h.
    """
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), crc.alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))

    def rows(batch):
        out = []
        for text, h in zip(batch["text"].to_pylist(), batch["h"].to_pylist(), strict=True):
            words, g = (text or "").encode().split(), h // 10
            if words:
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                times = -(-(len(words) - a) // p)
                words = words[:a] + (words[a : a + p] * times)[: len(words) - a]
            out.append(b" ".join(words).decode())
        yield {"doc_id": batch["doc_id"], "text": out}

    return narrow.where(~chosen).drop("h").unionByName(common.arrow_map(narrow.where(chosen), rows, "doc_id long, text string"))
