"""BPE encoding by tree concatenation, and decoding.

Texts of at most ``LEAF_CHARS`` characters are encoded where they are read.  A longer one
is cut in halves, and those again, down to leaves of that size; every leaf is a row of its
own, so the leaves of one text are encoded by many tasks.  A cut may fall within a word or
any other run that the tokenizer never splits.  Neighbours are then joined pairwise, level
by level: around each join a window of tokens is encoded again, and grows until its first
and last token are those that the two sides have there.  Any two adjacent tokens of the
joined sequence then stand beside each other in an encoding by the model, which is all that
tells a model's own output from other sequences, so the result equals whole-text encoding.

Null texts are empty and have no ids; decoding null ids gives null.  Repeated rows and null
ids come out row by row, an empty table gives no rows, ids that the vocabulary lacks are
left out by decoding as the library does, and columns other than doc_id and text are not
looked at.  Where no cut is safe (say, in a megabyte of combining marks) a leaf is longer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, encode

LEAF_CHARS = 1 << 14
#: Tokens on either side of a join that are encoded again at first.
WINDOW = 4

_KEY = ["_doc", "_key", "_part", "_nth"]
_LEAF = "doc_id long, _doc long, _key long, _part int, _nth long, _leaf int, _leaves int, open_left boolean, open_right boolean"
TOKENS = "doc_id long, n_tokens long, ids binary"

_TREES: dict[str, Tree] = {}


@dataclass
class Span:
    """Encoded text between two cuts.

    ``head`` and ``tail`` are the tokens of the first and last piece where the cut there
    runs through that piece, else 0.
    """

    ids: np.ndarray
    open_left: bool = False
    open_right: bool = False
    head: int = 0
    tail: int = 0

    @property
    def one_piece(self) -> bool:
        return self.open_left and self.head == len(self.ids) or self.open_right and self.tail == len(self.ids)


class Tree:
    """Cuts texts, encodes leaves and joins them, for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import models

        self.encoder = encode.encoder(path)
        tokenizer = self.encoder.tokenizer
        spec = json.loads(tokenizer.to_str())
        model, added = spec["model"], spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that reach into the text around them")
        self.special = {t["content"]: t["id"] for t in added}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names = {i: s for s, i in model["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges) if self.suffix else tokenizer.model
        self.drops_space = self.encoder.drops_space
        self.single_digits = len(tokenizer.pre_tokenizer.pre_tokenize_str("11")) == 2

    # cuts

    def leaves(self, text: str, most: int = LEAF_CHARS) -> list[tuple[int, int, bool, bool]]:
        """begin, end, open_left, open_right of the leaves of ``text``, in order."""
        out, todo = [], [(0, len(text), False, False)]
        while todo:
            begin, end, left, right = todo.pop()
            cut = self.cut(text, begin, end) if end - begin > most else None
            if cut is None:
                out.append((begin, end, left, right))
            else:
                at, opened = cut
                todo += [(at, end, opened, right), (begin, at, left, opened)]
        return out

    def cut(self, text: str, begin: int, end: int) -> tuple[int, bool] | None:
        """The safe cut nearest to the middle, in the middle half, and whether it runs through a piece."""
        middle, reach = (begin + end) // 2, (end - begin) // 4
        for i in range(2 * reach):
            at = middle + (i + 1) // 2 * (1 if i % 2 else -1)
            if (opened := self.safe(text, at)) is not None:
                return at, opened
        return None

    def safe(self, text: str, at: int) -> bool | None:
        """Do both sides of a cut normalise and split into pieces as within the text; True if it runs through a piece."""
        if at < 4 or at >= len(text):
            return None
        before, after = text[at - 1], text[at]
        if not after.isascii() and after in _joining():
            return None
        if all(map(_letter, text[at - 3 : at])) and _letter(after):
            opened = True
        elif _mark(before) and _mark(after):
            opened = True
        elif self.drops_space and after in " \n" and not before.isspace() or self.single_digits and self.drops_space and _digit(before) and _digit(after):
            opened = False
        else:
            return None
        return None if any(s in text[max(0, at - len(s)) : at + len(s)] for s in self.special) else opened

    # leaves

    def leaf(self, text: str, open_left: bool, open_right: bool) -> Span:
        """A leaf by the library, its words from the worker's cache; pieces that a cut runs through are told apart."""
        if not open_left and not open_right:
            return Span(self.encoder.encode_many([text])[0])
        gaps = [m.start() for m in (_FIRST_GAP.search(text), _last_gap(text)) if m]
        begin, end = (gaps[0] if open_left else 0, gaps[-1] if open_right else len(text)) if gaps else (0, 0)
        head = self._pieces(text[:begin], False) if gaps and open_left else []
        tail = self._pieces(text[end:], open_right) if not gaps or open_right else []
        middle = self.encoder.encode_many([text[begin:end]])[0]
        parts = [*head, *([middle] if len(middle) else []), *tail]
        first = len(parts[0]) if open_left else 0
        last = len(parts[-1]) if open_right else 0
        return Span(np.concatenate(parts).astype(np.uint32), open_left, open_right, first, last)

    def _pieces(self, text: str, open_right: bool) -> list[np.ndarray]:
        """The ids of each piece of ``text``; the last one goes on behind the text if ``open_right``."""
        tokenizer, out, last = self.encoder.tokenizer, [], None
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
                continue
            for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part) if tokenizer.normalizer else part):
                out.append(self._ids(piece, True))
                last = piece
        if open_right:
            out[-1] = self._ids(last, False)
        return out

    def _ids(self, piece: str, closed: bool) -> np.ndarray:
        model = self.encoder.tokenizer.model if closed else self.inner
        return np.array([t.id for t in model.tokenize(piece)], np.uint32)

    # joins

    def joined(self, left: Span, right: Span) -> Span:
        """Two neighbours as one."""
        if not left.open_right:
            return Span(np.concatenate([left.ids, right.ids]), left.open_left, right.open_right, left.head, right.tail)
        a, b = left.ids[len(left.ids) - left.tail :], right.ids[: right.head]
        goes_on = right.open_right and right.one_piece
        n, window = self.seam(a, b, not goes_on)
        ids = np.concatenate([left.ids[: len(left.ids) - min(n, len(a))], window, right.ids[min(n, len(b)) :]])
        piece = len(a) + len(b) + len(window) - min(n, len(a)) - min(n, len(b))
        starts_before = left.open_left and left.one_piece
        return Span(ids, left.open_left, right.open_right, piece if starts_before else left.head, piece if goes_on else right.tail)

    def seam(self, a: np.ndarray, b: np.ndarray, closed: bool) -> tuple[int, np.ndarray]:
        """How many tokens of each side of a piece the last window takes, and what replaces them."""
        n = WINDOW
        while True:
            left, right = a[-n:], b[:n]
            all_left, all_right = n >= len(a), n >= len(b)
            text = "".join([self.names[i] for i in (*left.tolist(), *right.tolist())])
            ends = closed and all_right
            ids = self._ids(text.removesuffix(self.suffix) if ends and self.suffix else text, ends)
            if (all_left or ids[0] == left[0]) and (all_right or ids[-1] == right[-1]):
                return n, ids
            n *= 2

    def concatenated(self, spans: list[Span]) -> Span:
        """All spans of a text as one, by a balanced tree of joins."""
        while len(spans) > 1:
            spans = [self.joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
        return spans[0]

    def encode(self, text: str | None, most: int = LEAF_CHARS) -> np.ndarray:
        """All ids of one text, in this process."""
        text = text or ""
        return self.concatenated([self.leaf(text[a:b], x, y) for a, b, x, y in self.leaves(text, most)]).ids


#: A single space between words, before which every supported tokenizer cuts.
_FIRST_GAP = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _last_gap(text: str) -> re.Match | None:
    reach = 256
    while True:
        found = list(_FIRST_GAP.finditer(text, max(0, len(text) - reach)))
        if found or reach >= len(text):
            return found[-1] if found else None
        reach *= 8


def _letter(c: str) -> bool:
    """A letter that normalising leaves one letter."""
    if c.isascii():
        return c.isalpha()
    low = c.lower()
    return len(low) == 1 and unicodedata.category(low)[0] == "L" and unicodedata.category(c)[0] == "L" and unicodedata.is_normalized("NFC", c)


def _mark(c: str) -> bool:
    return c.isascii() and c.isprintable() and not c.isalnum() and c not in " '"


def _digit(c: str) -> bool:
    return c.isascii() and c.isdigit()


@cache
def _joining() -> frozenset[str]:
    """Characters that may combine with the one before: marks, second parts of composed characters, joining jamo."""
    out = {chr(c) for c in range(0x1160, 0x1200)}
    for c in map(chr, range(0x80, 0x110000)):
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<" and " " in parts:
            out.add(chr(int(parts.rpartition(" ")[2], 16)))
        if unicodedata.combining(c):
            out.add(c)
    return frozenset(out)


def tree(path: str) -> Tree:
    """The worker's tree for a vocabulary file; it goes when the encoders go."""
    if path not in _TREES or _TREES[path].encoder is not encode.encoder(path):
        _TREES[path] = Tree(path)
    return _TREES[path]


def _token_rows(doc_ids, ids: np.ndarray, counts: np.ndarray) -> dict:
    from tablehealth.llm import scan

    return {"doc_id": doc_ids, "n_tokens": counts, "ids": scan.binary(ids.astype("<u4"), np.concatenate([[0], np.cumsum(counts)]))}


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > leaf_chars

    def short_rows(batch):
        ids, counts = encode.encoder(path).encode_many(batch["text"].to_pylist())
        yield _token_rows(batch["doc_id"], ids, counts)

    def cut_rows(batch):
        part = TaskContext.get().partitionId()
        if seen.get("part") != part:
            seen.clear()
            seen["part"] = part
        for i, (text, key) in enumerate(zip(batch["text"].to_pylist(), batch["_key"].to_pylist(), strict=True)):
            nth = seen[key] = seen.get(key, -1) + 1  # repeated rows are told apart within their partition
            leaves = tree(path).leaves(text, leaf_chars)
            m = len(leaves)
            same = batch.slice(i, 1).take(pa.array([0] * m, pa.int64()))
            yield {"doc_id": same["doc_id"], "_doc": same["_doc"], "_key": same["_key"], "_part": [part] * m, "_nth": [nth] * m, "_leaf": list(range(m)), "_leaves": [m] * m, "open_left": [x[2] for x in leaves], "open_right": [x[3] for x in leaves], "text": [text[a:b] for a, b, _, _ in leaves]}

    def leaf_rows(batch):
        columns = {n: batch[n] for n in batch.schema.names if n != "text"}
        spans = [tree(path).leaf(*x) for x in zip(batch["text"].to_pylist(), batch["open_left"].to_pylist(), batch["open_right"].to_pylist(), strict=True)]
        yield columns | {"head": [s.head for s in spans], "tail": [s.tail for s in spans], "ids": [s.ids.astype("<u2").tobytes() for s in spans]}

    def joined_rows(batches):
        """Leaves come sorted: those of one text stand together."""
        held: list[Span] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(Span(np.frombuffer(row["ids"], "<u2").astype(np.uint32), row["open_left"], row["open_right"], row["head"], row["tail"]))
                if row["_leaf"] + 1 == row["_leaves"]:
                    ids, held = tree(path).concatenated(held).ids, []
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    seen: dict = {}
    whole = common.arrow_map(narrow.where(~long), short_rows, TOKENS, tokens=True)
    cut = common.arrow_map(narrow.where(long).withColumns({"_doc": F.coalesce("doc_id", F.lit(common.LAST_ID)), "_key": common.row_key()}), cut_rows, f"{_LEAF}, text string", tokens=True)
    leaves = common.arrow_map(cut.repartition(*_KEY, "_leaf"), leaf_rows, f"{_LEAF}, head long, tail long, ids binary", tokens=True)
    joined = leaves.repartition(*_KEY).sortWithinPartitions(*_KEY, "_leaf").mapInArrow(joined_rows, TOKENS)
    return whole.unionByName(joined)


class Decoder:
    """Ids to text as the library's ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, path: str):
        self.tokenizer = encode.encoder(path).tokenizer
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        # Without a decoder the library puts a space between the tokens' own names.
        self.names = None if self.tokenizer.decoder else [self.tokenizer.id_to_token(i) for i in range(size)]

    def __call__(self, ids: np.ndarray) -> str:
        if self.names is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        known = ids[ids < len(self.names)].tolist()
        return " ".join([n for n in map(self.names.__getitem__, known) if n is not None])


_DECODERS: dict[str, Decoder] = {}


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` with the ids' ``text``."""

    def rows(batch):
        if path not in _DECODERS:
            _DECODERS[path] = Decoder(path)
        decoder = _DECODERS[path]
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield {n: part[n] for n in ("doc_id", "n_tokens", "ids")} | {"text": [None if x is None else decoder(np.frombuffer(x, "<u4")) for x in part["ids"].to_pylist()]}

    return common.arrow_map(tokens.select("doc_id", "n_tokens", "ids"), rows, f"{TOKENS}, text string", tokens=True)
