"""Token ids by the tokenizers library, with a per-worker cache of encoded pieces.

A text is cut only where the tokenizer always cuts, pieces seen before are looked up,
and new ones are encoded by the library in batches; ``tests/llm`` holds the result
against whole-text encoding.  Texts with unusual white space are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a worker's piece cache; it starts afresh when full.
CACHE_PIECES = 600_000

_ENCODERS: dict[str, Encoder] = {}
#: Stands for "no space before" in front of a mark that was parted from its word.
_CLOSING = "\x00"
_DOUBLE = re.compile(r"[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][,.](?:[ \n]|$)")


class Encoder:
    """Encodes texts as arrays of 32-bit ids; ids must fit in 16 bits."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.vocabulary > 1 << 16:
            raise ValueError(f"{path}: ids of {self.vocabulary} tokens do not fit in 16 bits")
        self.spaced: dict[str, bytes] = {}
        self.opening: dict[str, bytes] = {"": b""}
        self.newline = self._ids("\n").astype("<u2").tobytes()
        # A tokenizer that drops white space gives a piece the same ids wherever it stands.
        self.drops_space = not self.newline and not len(self._ids(" "))
        kind = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        if not any(x["type"] == "ByteLevel" for x in kind.get("pretokenizers", [kind])):
            raise ValueError(f"{path}: not a byte-level model")
        self.closing = {_CLOSING + m: self._ids(m).astype("<u2").tobytes() for m in ",."}
        self.mark = "\x01" if self.drops_space else "\n"
        mark = self._ids(self.mark)
        self.mark_id = int(mark[0]) if len(mark) == 1 else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: set[str], known: dict[str, bytes], lead: str) -> None:
        """Encode pieces that are not known yet.

        A word of Latin letters is one piece for the tokenizer too, and goes to its model at
        once.  Others are encoded in batches, a mark of its own id between any two, and cut there.
        """
        new = list(pieces.difference(known))
        if not new:
            return
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = list(pieces)
        tokenize, cover = self.tokenizer.model.tokenize, lead.translate(_BYTE_LEVEL)
        for p in new:
            if p.isalpha() and (p.isascii() or p <= "\u0100" and max(p) < "\u0100") and (not self.drops_space or p == p.lower()):
                known[p] = array("H", [x.id for x in tokenize(cover + (p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LEVEL)))]).tobytes()
        new = [p for p in new if p not in known]
        odd = [p for p in new if self.mark in p or "<|" in p] if self.mark_id is not None else new
        for p in odd:
            known[p] = self._ids(lead + p).astype("<u2").tobytes()
        plain = [p for p in new if p not in known]
        groups = [plain[i : i + 16] for i in range(0, len(plain), 16)]
        joint = (f" {self.mark} " if self.drops_space else self.mark + lead).join
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([lead + joint(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(group) - 1:  # never seen; then each piece on its own
                for p in group:
                    known[p] = self._ids(lead + p).astype("<u2").tobytes()
                continue
            raw, begin = ids.astype("<u2").tobytes(), 0
            for p, to in zip(group, [*cut.tolist(), len(ids)], strict=True):
                known[p] = raw[2 * begin : 2 * to]
                begin = to + 1

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of one text as unsigned 32-bit integers; null is empty."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        raw = self._spaced(texts) if self.drops_space else self._lined(texts)
        return np.frombuffer(b"".join(raw), "<u2").astype(np.uint32), np.array([len(x) // 2 for x in raw], np.int64)

    def _spaced(self, texts: list[str | None]) -> list[bytes]:
        pieces = [_folded(t or "").replace("\n", " ").split(" ") for t in texts]
        self._learn(set().union(*pieces) - {""}, self.spaced, "")
        self.spaced[""] = b""
        look = self.spaced.__getitem__
        return [b"".join(map(look, x)) for x in pieces]

    def _lined(self, texts: list[str | None]) -> list[bytes]:
        unusual = [_unusual(t) for t in texts]
        lines = [[] if odd else [line.split(" ") for line in _parted(t or "", " " + _CLOSING).split("\n")] for t, odd in zip(texts, unusual, strict=True)]
        self._learn({line[0] for x in lines for line in x}, self.opening, "")
        self._learn(set().union(*(line[1:] for x in lines for line in x)) - self.closing.keys(), self.spaced, " ")
        self.spaced |= self.closing
        look, first = self.spaced.__getitem__, self.opening
        return [
            self._ids(t).astype("<u2").tobytes() if odd else self.newline.join([first[x[0]] + b"".join(map(look, x[1:])) for x in own])
            for t, odd, own in zip(texts, unusual, lines, strict=True)
        ]


def _byte_level() -> dict[int, str]:
    """How byte-level models spell bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_LEVEL = _byte_level()


def _unusual(text: str | None) -> bool:
    """White space other than single spaces and newlines between words."""
    return bool(text) and (_CLOSING in text or text.split() != text.replace("\n", " ").split(" "))


def _parted(text: str, gap: str) -> str:
    """``gap`` before each comma or full stop that ends a word, where tokenizers cut anyway.

    Left alone are texts in which such a mark follows another mark: those two may be one token.
    """
    if _CLOSING in text or _DOUBLE.search(text):
        return text
    for mark in ",.":
        text = text.replace(mark + " ", f"{gap}{mark} ").replace(mark + "\n", f"{gap}{mark}\n")
    return text


def _folded(text: str) -> str:
    """The text as a tokenizer sees it that lower-cases: within Latin-1, both agree letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _parted(text, " ")
    return _parted(text.lower(), " ")


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop all encoders and their caches."""
    _ENCODERS.clear()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
