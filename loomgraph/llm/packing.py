"""Packing of token sequences into as few fixed-size ones as possible, by bin completion.

1. One pass tokenises the texts (see :mod:`piece_codec`: chunks are words, cut at punctuation), adds the
   end id and cuts only what is longer than a sequence.
2. Pieces of one length are interchangeable, so the counts by length say all that a
   packing needs: at most ``size`` numbers, however large the corpus. The driver packs
   these. For the longest piece left, branch and bound yields the fillings of the room it
   leaves by rising waste (Korf 2002, "bin completion"); those that another dominates are passed over. One is used as
   often as the counts allow, and the search goes on with what is left. It turns back where waste or a lower bound
   says that no better plan follows, until a plan meets the lower bound or all have been tried. Best fit for
   all sequences only says how many a plan may have; it stands where the search, which ends
   ``TRIES`` fillings after it first turned back, has none of as few. A plan that isn't proven best is told by a warning.
3. Pieces are numbered within their length, in parts so that no task holds a whole
   length, and each looks up its place in the plan.

:func:`pack` returns the pieces with their ids. :func:`place` does so for pieces without them, where only
places are asked for: then nothing but a few dozen bytes of a piece is shuffled.

Nulls: a null text is empty: its document is the end id alone. A null id is packed like
any other. Rows that repeat an id are packed one by one. Very long texts are tokenised one at a
time and cut into pieces. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import logging
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .piece_codec import ChunkTable, flat
from .storage import partitions, pick, written
from .words import Slice, ragged, slices


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _separator(path: str) -> tuple[str, int] | None:
    """A special token, which ends what is before it and begins what is behind it, and its id."""
    tokenizer = _tokenizer(path)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for i, token in sorted(tokenizer.get_added_tokens_decoder().items()):
        if token.special and ids(f"ab{token.content}c") == [*ids("ab"), i, *ids("c")]:
            return token.content, i
    return None


#: Chunks that are encoded as one text.
TOGETHER = 64


def _encoder(path: str):
    tokenizer, separator = _tokenizer(path), _separator(path)

    def apart(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [c.decode("utf-8") for c in chunks]
        if not separator or any(separator[0][:2] in w for w in words):
            return flat(apart(words))
        between, cut = separator
        texts = [between.join(words[i : i + TOGETHER]) + between for i in range(0, len(words), TOGETHER)]
        ids, _ = flat(apart(texts))
        return ids[ids != cut], np.diff(np.flatnonzero(ids == cut), prepend=-1) - 1

    return encode


#: By byte: 1 ASCII letters and digits, 2 ASCII punctuation but the apostrophe, 0 all others.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(33, 127) if not _KIND[c] and c != 39]] = 2


def chunks(s: Slice) -> tuple[np.ndarray, np.ndarray, bool]:
    """Starts and ends of runs that the tokenizer splits its words at anyway, and whether case counts.

    Words are cut between ASCII letters or digits and punctuation: there the tokenizer's pattern always
    ends a match, but next to an apostrophe. Where a text holds the start of a special token,
    which case and punctuation are part of, the slice's words stay whole.
    """
    if b"<|" in s.data.tobytes():
        return s.start, s.end, True
    kind = _KIND[s.data]
    cut = np.zeros(len(kind), bool)
    cut[1:] = kind[1:] * kind[:-1] == 2
    cut[s.bounds[:-1][s.bounds[:-1] < len(cut)]] = False
    cut[s.start] = True
    start = np.flatnonzero(cut)
    end = np.minimum(np.r_[start[1:], len(kind)], s.end[np.searchsorted(s.start, start, side="right") - 1])
    return start, end, False


_PIECE = "doc_id long, piece int, start long, length long, ids binary"


def _pieces(path: str, size: int, end: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        table = ChunkTable(_encoder(path))
        for batch in batches:
            for s in slices(batch.column(1)):
                start_at, end_at, cased = chunks(s)
                places = table.places(s, start_at, end_at, lower=not cased)
                first, lengths = np.searchsorted(start_at, s.bounds), table.length[places]
                ends = np.r_[0, np.cumsum(lengths)][first]
                # each document's ids and its end
                ids = np.insert(table.ids[ragged(table.start[places], lengths)], ends[1:], end).astype("<u4")
                ends = ends + np.arange(s.n + 1)
                counts = -(-np.diff(ends) // size)
                doc = np.repeat(np.arange(s.n), counts)
                piece = ragged(np.zeros(s.n, np.int64), counts)
                start = piece * size
                length = np.minimum(ends[doc + 1] - ends[doc] - start, size)
                begins = np.r_[ends[doc] + start, len(ids)].astype(np.int32) * 4
                packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(begins), pa.py_buffer(ids)])
                columns = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), packed]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.rows[0] + doc)), *columns], names=["doc_id", "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length and its ids, 32 bits each, least byte first."""
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(_pieces(tokenizer, size, end_id), _PIECE)


def _best_fit(counts: np.ndarray, room: int) -> list[int]:
    """The longest piece that fits, again and again."""
    out, top = [], room
    while room > 0:
        fits = np.flatnonzero(counts[: min(room, top) + 1])
        if not len(fits):
            break
        top = int(fits[-1])
        n = min(int(counts[top]), room // top)
        out += [top] * n
        room -= n * top
        top -= 1
    return out


def _exact(counts: np.ndarray, lengths: list[int], reach: list[int], goal: int) -> Iterator[list[int]]:
    """Fillings of this sum, those of longer pieces first. reach[i]: bits of the sums of lengths[:i]."""
    i, n, taken = len(lengths) - 1, None, []
    while True:
        while i >= 0 and goal:
            if n is None:
                n = min(int(counts[lengths[i]]), goal // lengths[i])
            while n >= 0 and not reach[i] >> goal - n * lengths[i] & 1:
                n -= 1
            if n < 0:
                break
            taken.append(n)
            goal -= n * lengths[i]
            i, n = i - 1, None
        else:
            yield [x for x, k in zip(lengths[::-1], taken, strict=False) for _ in range(k)]
        while True:
            if not taken:
                return
            i, n = i + 1, taken.pop()
            goal += n * lengths[i]
            if n:
                n -= 1
                break


def completions(counts: np.ndarray, room: int) -> Iterator[list[int]]:
    """Lengths that fill ``room``, all ways by rising waste, longer pieces first; ``counts[l]`` pieces of length l are there.

    Branch and bound over how many pieces of each length to take, longest first. The bound is
    exact: a set of bits for each length says which sums that length and all shorter ones can
    reach, so the least waste is known at the root, the best-fit incumbent is the first if it has none,
    and a branch whose shorter lengths can't reach what is left is cut before it is entered.
    """
    best = _best_fit(counts, room)
    if sum(best) == room:
        yield best  # the longest pieces, again and again: the first of its sum
    lengths = np.flatnonzero(counts[: room + 1]).tolist()
    full = (1 << room + 1) - 1
    reach = [1]
    for length in lengths:
        sums, left, n = reach[-1], min(int(counts[length]), room // length), 1
        while left:
            n = min(n, left)
            sums |= sums << n * length & full
            left -= n
            n *= 2
        reach.append(sums)
    for goal in range(room, -1, -1):
        if reach[-1] >> goal & 1:
            fillings = _exact(counts, lengths, reach, goal)
            if goal == room and sum(best) == room:
                next(fillings)
            yield from fillings


def completion(counts: np.ndarray, room: int) -> list[int]:
    """The filling of least waste and, among those, of the longest pieces: it isn't dominated."""
    return next(completions(counts, room))


def _shifted(bits: int, n: int) -> int:
    """bits moved up by each of 0 to n places."""
    done = 0
    while done < n:
        step = min(done + 1, n - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: list[int], counts: np.ndarray, room: int) -> bool:
    """Whether a piece left over could stand in the place of some of the filling's that are no longer, or in its waste:
    then that filling needs no more sequences, as what it sets free fits wherever that piece would be."""
    waste = room - sum(filling)
    lengths, each = np.unique(np.array(filling, np.int64), return_counts=True)
    over = counts > 0
    over[lengths] = counts[lengths] > each
    free = int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little") & ~1
    one = more = 0  # bits of single lengths, and of sums of two or more
    for x in filling:
        more |= (one | more) << x
        one |= 1 << x
    longer = _shifted((one | 1) << 1, waste - 1) if waste else 0
    return bool((longer | _shifted(more, waste)) & free)


#: Lengths, longest first, how many of each are in a sequence, and for how many sequences.
Step = tuple[list[int], list[int], int]


def _step(left: np.ndarray, longest: int, filling: list[int]) -> Step:
    lengths, each = np.unique([longest, *filling], return_counts=True)
    return lengths[::-1].tolist(), each[::-1].tolist(), int((left[lengths] // each).min())


def _best_fits(counts: np.ndarray, size: int) -> list[Step]:
    """Sequences, longest piece first, each filled up by best fit."""
    left, out = counts.copy(), []
    while (some := np.flatnonzero(left)).size:
        longest = int(some[-1])
        left[longest] -= 1
        filling = _best_fit(left, size - longest)
        left[longest] += 1
        step = _step(left, longest, filling)
        left[step[0]] -= np.array(step[1]) * step[2]
        out.append(step)
    return out


#: Fillings that the search looks at after it first turns back. No polynomial search is exact.
TRIES = 20_000


def _search(counts: np.ndarray, size: int, most: int, least: int, tries: int = TRIES) -> tuple[list[Step] | None, bool]:
    """Bin completion: steps of a plan of ``most`` sequences or fewer, and whether none has fewer than it, or than most + 1.

    Depth first: the longest piece left is completed by each undominated filling in turn, by rising waste, for as many
    sequences as it can, then for fewer. A branch is cut where its waste, or the lower bound of what is left,
    needs more than ``most``, and where the same pieces were left over before.
    """
    left, total = counts.copy(), int(counts @ np.arange(size + 1))
    path: list[Step] = []
    found: list[Step] | None = None
    used, waste, tried, end = 0, 0, 0, None
    seen: dict[bytes, int] = {}

    def options(longest: int) -> Iterator[Step]:
        nonlocal tried
        room = size - longest
        now = left.copy()
        now[longest] -= 1
        for filling in completions(now, room):
            tried += 1
            lost = room - sum(filling)
            if lost > most * size - total - waste or end is not None and tried > end:
                return
            if dominated(filling, now, room):
                continue
            lengths, each, uses = _step(left, longest, filling)
            for n in range(uses, 0, -1):
                if n < uses:
                    tried += 1
                yield lengths, each, n

    def below() -> Iterator[Step]:
        """What can follow: nothing where the branch is cut."""
        nonlocal found, most
        some = np.flatnonzero(left)
        if not len(some):
            found, most = list(path), used - 1
            return iter(())
        key = blake2b(left.tobytes(), digest_size=16).digest()
        if seen.get(key, used + 1) <= used or used + _least(left, size) > most:
            return iter(())
        seen[key] = used
        return options(int(some[-1]))

    stack = [below()]
    while stack and most >= least:
        step = next(stack[-1], None) if end is None or tried <= end else None
        if step is None:
            if end is None:
                end = tried + tries
            elif tried > end:
                break
            stack.pop()
            if path:
                lengths, each, n = path.pop()
                left[lengths] += np.array(each) * n
                used -= n
                waste -= n * (size - int(np.dot(lengths, each)))
            continue
        lengths, each, n = step
        lost = n * (size - int(np.dot(lengths, each)))
        if lost > most * size - total - waste:
            continue
        left[lengths] -= np.array(each) * n
        used, waste = used + n, waste + lost
        path.append(step)
        stack.append(below())
    return found, not stack or most < least


def _least(left: np.ndarray, size: int) -> int:
    number, total = np.cumsum(left), np.cumsum(left * np.arange(size + 1))
    k = np.arange(size // 2 + 1)
    alone = number[size] - number[size - k]
    half = number[size - k] - number[size // 2]
    room = half * size - (total[size - k] - total[size // 2])
    small = total[size // 2] - np.where(k > 0, total[k - 1], 0)
    return max(-(-int(total[-1]) // size), int((alone + half + np.maximum(0, -(-(small - room) // size))).max()))


def _left(counts: dict[int, int], size: int) -> np.ndarray:
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    return left


def least_sequences(counts: dict[int, int], size: int) -> int:
    """No packing has fewer (Martello, Toth 1990): pieces over size - k each have a sequence, those of k to
    size / 2 only what room these leave."""
    return _least(_left(counts, size), size)


Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], size: int) -> list[Run]:
    """Runs (length, first rank, uses, each, first sequence, offset): the ranks of a length from the first
    on, ``each`` to a sequence at the offset, for ``uses`` sequences. By bin completion; best fit says how many sequences
    it may take at most, and stands only where the search ends without a plan of as few."""
    left = _left(counts, size)
    best, least = _best_fits(left, size), _least(left, size)
    most = sum(uses for _, _, uses in best)
    steps, proven = _search(left, size, most, least)
    if not proven:
        n = sum(uses for _, _, uses in steps or best)
        logging.getLogger(__name__).warning("packed into %d sequences, %d are needed at least; the search ended after %d fillings", n, least, TRIES)
    rank, sequence = np.zeros(size + 1, np.int64), 0
    out: list[Run] = []
    for lengths, each, uses in steps or best:
        offset = 0
        for length, n in zip(lengths, each, strict=True):
            out.append((length, int(rank[length]), uses, n, sequence, offset))
            rank[length] += uses * n
            offset += length * n
        sequence += uses
    return out


def _placed(runs: np.ndarray):
    """Adds sequence_id and offset by length and rank, the last column. runs: sorted by length and first rank."""
    key = runs[:, 0].astype(np.float64) * 2.0**40 + runs[:, 1]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = runs[np.searchsorted(key, length.astype(np.float64) * 2.0**40 + rank, side="right") - 1]
            inside = rank - at[:, 1]
            names = batch.schema.names[:-1]
            columns = [*(batch.column(c) for c in names), pa.array(at[:, 4] + inside // at[:, 3]), pa.array(at[:, 5] + inside % at[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """pieces(doc_id, piece, length and any other columns) with sequence_id and offset.

    Pieces of one length are numbered in parts, by doc_id and piece within a part.
    """
    spark = pieces.sparkSession
    keys = ["doc_id", "piece"]
    # any numbers do, as long as they spread: the parts are written before they are counted
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(partitions(spark))).cast("int")
    pieces = written(pieces.withColumn("part", part), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    runs = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 6)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = by_part.select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), before.alias("base"))
    own = Window.partitionBy("length", "part").orderBy(*keys)
    names = [c for c in pieces.columns if c != "part"]
    ranked = (
        pieces.withColumn("own", F.row_number().over(own) - 1)
        .join(bases, F.expr("length = b_length AND part = b_part"))
        .select(*names, (F.col("base") + F.col("own")).alias("rank"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return ranked.mapInArrow(_placed(runs), f"{schema}, sequence_id long, offset long")


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids, sequence_id and offset."""
    return place(pieces(docs, tokenizer, id_col, text_col, size, end_id), size)
