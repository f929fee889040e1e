"""Words, n-grams and hashes of whole Arrow batches of texts.

A word is ``[^\\x20\\x09-\\x0D]+``. All texts of a slice share one byte buffer. Words are hashed in numpy,
8 bytes of each at a time; a bijection that is not linear mixes every block before the next. (A
polynomial in a fixed base, mod 2**64, would collide on periodic texts whatever its base.) Runs of
words are hashed by doubling: runs of 2, 4, 8 words from pairs of half as many, with the same mixing.
Nothing here loops over words in Python, but for words of more than ``LONG_WORD`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text held as arrays at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
_FOLD = np.uint64(0x9E3779B97F4A7C15)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case of A-Z only.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, in their order."""
    return mix(a * _FOLD + b)


def digests(parts: list[bytes]) -> np.ndarray:
    """64 bits of a digest of each part."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in parts]), np.uint64)


#: Longer words are digested one by one.
LONG_WORD = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SEEDS = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_SPREAD = np.uint64(0x8EBC6AF09C88C6E3)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span of bytes.

    Spans are read 8 bytes at a time, all of them at once, into two states that are updated by
    different bijections; both states enter both hashes. Spans over ``LONG_WORD`` bytes get halves of a digest.
    """
    length = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    one = mix(length.astype(np.uint64) + _SEEDS[0])
    two = mix(length.astype(np.uint64) ^ _SEEDS[1])
    at = np.flatnonzero(length <= LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        at = at[length[at] > j] if len(at) else at
        if not len(at):
            break
        block = blocks[start[at] + j] & _KEEP[np.minimum(length[at] - j, 8)]
        one[at] = mix(one[at] ^ block)
        two[at] = mix(two[at] + block * _SPREAD)
    one, two = join(one, two), join(two ^ _SEEDS[0], one)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        both = blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        one[i], two[i] = np.frombuffer(both, np.uint64)
    return one, two


def same_spans(data: np.ndarray, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether all spans (start, end) of one hold the same bytes as those of two, pair by pair."""
    length = one[1] - one[0]
    if (length != two[1] - two[0]).any():
        return False
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    at = np.flatnonzero((one[0] != two[0]) & (length <= LONG_WORD))
    for j in range(0, LONG_WORD, 8):
        at = at[length[at] > j]
        if ((blocks[one[0][at] + j] ^ blocks[two[0][at] + j]) & _KEEP[np.minimum(length[at] - j, 8)]).any():
            return False
    long = np.flatnonzero((one[0] != two[0]) & (length > LONG_WORD)).tolist()
    return all(np.array_equal(data[one[0][i] : one[1][i]], data[two[0][i] : two[1][i]]) for i in long)


class Slice:
    """Some consecutive documents of a batch.

    rows: (first, last) of the batch; data: bytes; bounds: byte offset of each
    document (n + 1); start, end: byte offsets of each word; ptr: index of each
    document's first word (n + 1).
    """

    def __init__(self, rows: tuple[int, int], data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds
        self.n = len(bounds) - 1
        inside = ~IS_SPACE[data]
        before = np.empty(len(data) + 1, bool)
        before[:1] = False
        before[1:] = inside
        before[bounds] = False
        after = np.empty(len(data) + 1, bool)
        after[:-1] = inside
        after[-1:] = False
        after[bounds] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.ptr = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.ptr)

    def raw(self, lower: bool = False) -> bytes:
        raw = self.data.tobytes()
        return raw.translate(ASCII_LOWER) if lower else raw

    def parts(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> list[bytes]:
        """The bytes of each span."""
        raw = self.raw(lower)
        return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def groups(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
        """The distinct ones of spans, and which of them each is. Hashes only propose: bytes decide."""
        data = _LOWER[self.data] if lower else self.data
        _, first, group = np.unique(span_hashes(data, start, end)[0], return_index=True, return_inverse=True)
        if same_spans(data, (start, end), (start[first][group], end[first][group])):
            return self.parts(start[first], end[first], lower), group
        found: dict[bytes, int] = {}
        group = np.array([found.setdefault(x, len(found)) for x in self.parts(start, end, lower)])
        return list(found), group

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the bytes of each span."""
        return span_hashes(_LOWER[self.data] if lower else self.data, start, end)

    def word_hash(self, lower: bool = False) -> np.ndarray:
        return self.spans(self.start, self.end, lower)[0]

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of k words in one document."""
        h = runs(words, k)
        fits = np.arange(len(h)) + k <= np.repeat(self.ptr[1:], self.counts)[: len(h)]
        first = np.flatnonzero(fits)
        return first, h[first]


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; documents' ends don't matter here."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out, done, width, level = None, 0, 1, words
    while True:
        if k & width:
            part = level[done : done + n]
            out = part if out is None else join(out, part)
            done += width
        if done == k:
            return mix(out + np.uint64(k))
        level = join(level[:-width], level[width:])
        width *= 2


def short_runs(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run of words [first, last), in as many steps as the longest has words."""
    h = mix((last - first).astype(np.uint64))
    for j in range(int((last - first).max(initial=0))):
        here = first + j < last
        h[here] = join(h[here], words[first[here] + j])
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of a batch in order, some at a time, each whole."""
    if not len(texts):
        return
    data, offsets = buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        low, high = offsets[first], offsets[last]
        yield Slice((first, last), data[low:high], offsets[first : last + 1] - low)
        first = last


def per_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out[ptr[1:]] - out[ptr[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] places, and so on."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
