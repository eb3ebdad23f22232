"""Vectorised text scanning over Arrow string buffers.

Everything here works on one slice of documents at a time: the UTF-8 bytes of all
its texts in one array plus the offset at which each document begins.  Hashes depend on
content only, so equal strings get equal hashes in every task.

Words, lines, shingles and spans, whose equality decides something, are hashed by chains of
multiplications and shifts or by xxh3; where 64 bits may not do, callers take 128.
``Rolling`` is polynomial modulo 2**64, under which some different strings always collide;
it picks places to look at and never decides that two texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 18

#: Fixed: the word separators \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_FOLDS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407))
#: Words of more bytes are hashed one by one.
_BLOCK_BYTES = 64
#: The low n bytes of a 64-bit block, for n up to 8.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) <= n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])


_POWERS = _Powers(_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def fold(h: np.ndarray, codes: np.ndarray, which: int = 0) -> np.ndarray:
    """A chain of hashes taken one code further."""
    h = (h ^ codes) * _FOLDS[which]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def folded_windows(codes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k codes, by its first index, for small k."""
    n = max(0, len(codes) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = fold(h, codes[i : i + n], which)
    return h


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each byte string [start, end), eight bytes at a time for all strings at once."""
    blocks = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    length = end - start
    h = fold(mix(length.astype(np.uint64)), blocks[start] & _LOW_BYTES[np.minimum(length, 8)], which)
    left = np.flatnonzero((length > 8) & (length <= _BLOCK_BYTES))
    at = start[left] + 8
    while len(left):
        h[left] = fold(h[left], blocks[at] & _LOW_BYTES[np.minimum(end[left] - at, 8)], which)
        at += 8
        more = at < end[left]
        left, at = left[more], at[more]
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(length > _BLOCK_BYTES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], which)
    return h


def digests(items: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each range [start, end) of ``items`` (fixed-width rows), as two columns."""
    raw = memoryview(np.ascontiguousarray(items)).cast("B")
    width = items.dtype.itemsize * int(np.prod(items.shape[1:], initial=1))
    out = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((start * width).tolist(), (end * width).tolist(), strict=True)])
    both = np.frombuffer(out, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Rolling:
    """Hash of any run of k of a sequence of 64-bit codes: a quick pick of places, no proof of equality."""

    def __init__(self, codes: np.ndarray):
        self.powers = _POWERS
        self.powers.to(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.powers.up[: len(codes)], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Hash of every run of k codes, by its first index."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.powers.down[:n] + np.uint64(k))


class Slice:
    """Some whole documents: ``data`` bytes, ``offsets`` (n + 1), ``first`` row of the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Slice:
        return Slice(_LOWER[self.data], self.offsets, self.first)

    def codes(self) -> np.ndarray:
        return _CODES[self.data]

    def words(self, separators: np.ndarray = _SPACE) -> Words:
        return Words(self, separators)


class Words:
    """Words of a slice: ``start``/``end`` byte positions, ``offsets`` of each document's words."""

    def __init__(self, s: Slice, separators: np.ndarray = _SPACE):
        self.slice = s
        inside = ~separators[s.data]
        edge = np.ones(len(s.data) + 1, bool)  # a word may begin here: after a separator or a document's start
        np.logical_not(inside, out=edge[1:])
        edge[s.offsets] = True
        self.start = np.flatnonzero(inside & edge[:-1])
        closes = np.ones(len(s.data) + 1, bool)
        closes[:-1] = ~inside
        closes[s.offsets] = True
        self.end = np.flatnonzero(inside & closes[1:]) + 1
        self.offsets = np.searchsorted(self.start, s.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, which: int = 0) -> np.ndarray:
        return string_hashes(self.slice.data, self.start, self.end, which)


def whole_windows(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask over the windows of k items that lie within one document."""
    n = max(0, total - k + 1)
    last = np.zeros(n, bool)
    if n:
        marks = np.zeros(n + 1, np.int64)
        # a window that starts in the last k - 1 items of a document crosses its end
        begin, stop = np.maximum(offsets[1:] - (k - 1), offsets[:-1]), offsets[1:]
        np.add.at(marks, np.minimum(begin, n), 1)
        np.add.at(marks, np.minimum(stop, n), -1)
        last = np.cumsum(marks[:-1]) == 0
    return last


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    out, width = values, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < w:
        out = np.minimum(out[: len(out) - (w - width)], out[w - width :])
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For every window of w grams, the index of its smallest gram, the leftmost of equals.

    Grams are compared by their upper halves, whatever their number: equal windows must pick
    the same gram in every slice.
    """
    n = len(grams)
    if n < w:
        return np.zeros(0, np.int64)
    bits = np.uint64(32)
    packed = ((grams >> bits) << bits) | np.arange(n, dtype=np.uint64)
    return (sliding_min(packed, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, n = np.int64 if wide else np.int32, len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_count(column: pa.ChunkedArray) -> int:
    """Bytes of text in a string or binary column, those of its slice alone."""
    return sum(int(offsets[-1]) for offsets in (buffers(c)[1] for c in column.chunks))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's documents in slices of about ``size`` bytes; a longer document is a slice of its own."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Slice(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column out of one array of fixed-width items and the item offset of each row."""
    width = parts.dtype.itemsize
    at = offsets.astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])
