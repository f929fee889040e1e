"""Token ids of whole texts, by a table of the distinct chunks they are made of.

Where no piece of a vocabulary crosses a chunk's edge, the ids of a text are those of
its chunks, one after another. A task keeps one table from chunk to ids: each distinct
chunk is segmented once, and the ids are joined back by position with array lookups.
No text or id is shuffled, so a task needs only its own documents and its table, which
starts anew once it holds ``TABLE_CHUNKS`` chunks: that changes the time, not the ids.

Chunks of a SentencePiece model: a run of white space markers and what follows it up
to the next one. :func:`crossing_pieces` checks that no piece crosses their edges.
Chunks of a tokenizer that drops white space: words.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import pick
from .words import Slice, buffers, slices

#: Distinct chunks, and bytes of them and their ids, in a task's table before it starts anew.
TABLE_CHUNKS, TABLE_BYTES = 500_000, 32 << 20
MARKER = "▁"


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list behind the other, and how many each has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class ChunkTable:
    """Ids by the bytes of a chunk; ``encode`` gets the new ones and returns their ids, one chunk's behind the other's, and
    how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], chunks: int = TABLE_CHUNKS, size: int = TABLE_BYTES):
        self.encode, self.most, self.size = encode, chunks, size
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(8192, np.int32), 0
        self.chunks: list[bytes] = []
        self.bytes = 0

    def _fit(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def places(self, s: Slice, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """The table's place of each chunk of a slice."""
        distinct, group = s.groups(start, end, lower)
        return self.find(distinct)[group]

    def find(self, distinct: list[bytes]) -> np.ndarray:
        """The table's place of each of some distinct chunks."""
        if len(self.chunks) > self.most or self.bytes + 4 * self.used > self.size:
            self.clear()
        new = sorted(c for c, p in zip(distinct, map(self.at.get, distinct), strict=True) if p is None)
        if new:
            self._add(new)
        return np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))

    def _add(self, new: list[bytes]) -> None:
        base = len(self.chunks)
        ids, sizes = self.encode(new)
        total = len(ids)
        self._fit("start", base + len(new))
        self._fit("length", base + len(new))
        self._fit("ids", self.used + total)
        self.ids[self.used : self.used + total] = ids
        self.start[base : base + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.length[base : base + len(new)] = sizes
        self.used += total
        self.chunks += new
        self.bytes += sum(map(len, new))
        self.at.update(zip(new, range(base, base + len(new)), strict=True))

    def text_of(self, place: int) -> np.ndarray:
        return self.ids[self.start[place] : self.start[place] + self.length[place]]


@functools.cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def crossing_pieces(path: str) -> list[str]:
    """Pieces that hold a marker after another character: with any, chunks can't be segmented alone."""
    sp = processor(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return [p for p in pieces if MARKER in p.lstrip(MARKER)]


def _encoder(path: str):
    sp = processor(path)
    alone = sp.piece_to_id(MARKER)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # the model puts a marker before what it gets: the chunk's first
        texts = [c[1:].decode("utf-8") for c in chunks]
        return flat([ids if t else [alone] for t, ids in zip(texts, sp.encode(texts, num_threads=1), strict=True)])

    return encode


def marked_slices(texts: pa.Array):
    """Slices in which each text that isn't empty has a space before it, as the model's dummy prefix, and
    the starts of their chunks."""
    for batch_first in range(0, len(texts), 4096):
        part = texts.slice(batch_first, 4096)
        data, offsets = buffers(part)
        raw, mark = data.tobytes(), MARKER.encode()
        marked = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = raw[a:b]
            if mark in text:
                text = text.replace(mark, b" ")
            marked.append(b" " + text if text else b"")
        for s in slices(pa.array(marked, pa.binary())):
            space = s.data == 0x20
            before = np.zeros(len(space), bool)
            before[1:] = space[:-1]
            before[s.bounds[:-1][s.bounds[:-1] < len(space)]] = False
            yield batch_first + s.rows[0], s, np.flatnonzero(space & ~before)


def _codec(path: str):
    def run(batches):
        sp = processor(path)
        end = sp.eos_id()
        table = ChunkTable(_encoder(path))
        decimal: list[bytes] = []
        known: list[bytes] | None = None
        plain: list[bool] = []
        for batch in batches:
            for row, s, start in marked_slices(batch.column(1)):
                raw = s.data.tobytes()
                stop = np.r_[start[1:], len(raw)]
                places = table.places(s, start, stop)
                if known is not table.chunks:
                    known, decimal, plain = table.chunks, [], []
                for p in range(len(decimal), len(table.chunks)):
                    ids = table.text_of(p).tolist()
                    decimal.append(" ".join(map(str, ids)).encode())
                    plain.append(sp.decode(ids).encode() == table.chunks[p][1:])
                ptr = np.searchsorted(start, s.bounds)
                counts = np.r_[0, np.cumsum(table.length[places])]
                tokens = counts[ptr[1:]] - counts[ptr[:-1]] + 1
                odd = np.r_[0, np.cumsum(~np.array(plain, bool)[places])] if len(places) else np.zeros(1, int)
                at = places.tolist()
                hashes, decoded, ids_of = [], [], []
                for d in range(s.n):
                    a, b = ptr[d], ptr[d + 1]
                    line = b" ".join([*map(decimal.__getitem__, at[a:b]), b"%d" % end])
                    ids_of.append(line)
                    if odd[b] - odd[a]:
                        text = sp.decode([int(x) for x in line.split()]).encode()
                    else:
                        text = raw[s.bounds[d] + 1 : s.bounds[d + 1]]
                    hashes.append(hashlib.sha256(line).hexdigest())
                    decoded.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, s.n), pa.array(tokens.astype(np.int64)), pa.array(hashes), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _encode_rows(path: str):
    def run(batches):
        end = processor(path).eos_id()
        table = ChunkTable(_encoder(path))
        for batch in batches:
            for row, s, start in marked_slices(batch.column(1)):
                places = table.places(s, start, np.r_[start[1:], len(s.data)])
                ptr = np.searchsorted(start, s.bounds)
                ids = [
                    np.r_[np.concatenate([table.text_of(p) for p in places[a:b]]) if b > a else np.empty(0, np.int32), end].astype(np.int32)
                    for a, b in zip(ptr[:-1], ptr[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, s.n), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode_rows(path: str):
    def run(batches):
        sp = processor(path)
        for batch in batches:
            texts = [None if x is None else sp.decode([i for i in x if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _usable(model: str) -> str:
    crossing = crossing_pieces(model)
    if crossing:
        raise ValueError(f"pieces cross white space markers, so chunks can't be segmented alone: {crossing[:5]}")
    return model


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ids with the end id last, exactly as the library encodes the whole text.

    A null text is empty (the end id alone); ids may be null or repeated, rows are independent.
    """
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(_encode_rows(_usable(model)), "doc_id long, ids array<int>")


def decode(ids: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and text. Null ids give a null text; null parts are skipped."""
    return pick(ids, doc_id=id_col, ids=ids_col).mapInArrow(_decode_rows(model), "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the ids' decoding, in one pass.

    Where each chunk of a text decodes to itself, so does the text; all others are decoded whole.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(_codec(_usable(model)), schema)

