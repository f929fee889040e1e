"""Log probability of documents under a subword lattice, beside add-0.1 word counts.

Tokens: words (A-Z lower-cased), then one end. The lattice of a word holds every way to
write it (behind a white space marker) with the pieces of an existing vocabulary, bytes
standing in for characters it lacks. The forward recursion adds up all segmentations, so a word's
value is its marginal log probability and a document's the sum over its words and the end.

Pieces are weighed by the vocabulary's scores and by the training words. The scores of a vocabulary
made by merging pairs are negative ranks, not log probabilities, so they are read by Zipf's law: a share
of 1 / (rank + ``ZIPF``), to scale. A piece's weight is its share among the pieces of the training words, as
the scores segment them, with the shares of the scores as ``PRIOR`` more pieces.

1. Each task counts its distinct words once and its pieces with them. Piece counts are
   summed over the vocabulary (32,000 rows), word counts over all words.
2. Each distinct word of the corpus runs through the lattice once.
3. Words with more than one in ``1 / share`` of all tokens are at most ``1 / share`` in
   number, whatever the input; they are sent to every task. Only the others are shuffled,
   as (hash, document, count), and meet their counts in a join that no word dominates.

Nulls: a null text is empty (its end alone). A null id is learned from and not held out;
rows that repeat an id and text get the same scores. Very long texts are taken one at a time, in memory
in proportion to their bytes; equal words have one value, so ties can't differ. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_codec import MARKER, processor
from .storage import discard, pick, written
from .words import ASCII_LOWER, mix, signed, slices

#: Distinct words, and bytes of them, that a task counts before it hands them on.
FLUSH_WORDS, FLUSH_BYTES = 100_000, 16 << 20
SMOOTHING = 0.1
#: Pieces that the vocabulary's scores count as, and what is added to a rank.
PRIOR, ZIPF = 3200.0, 2.7
_NO_PROB = -math.inf


def held_out(doc_id: str):
    """crc32 of the id as text, mod 10, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def _count_words(batches):
    """Columns: learn, text. Distinct words of a task so far: hash, word, count in training texts."""
    known: dict[int, list] = {}
    size = 0

    def flush():
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(list(known), np.uint64).view(np.int64)),
                pa.array([w for w, _ in known.values()], pa.binary()),
                pa.array([n for _, n in known.values()], pa.int64()),
            ],
            names=["h", "word", "n"],
        )
        known.clear()
        return out

    for batch in batches:
        learn = batch.column(0).to_numpy(zero_copy_only=False)
        for s in slices(batch.column(1)):
            raw = s.data.tobytes()
            weight = np.repeat(learn[s.rows[0] : s.rows[1]], s.counts)
            distinct, first, group = np.unique(s.word_hash(lower=True), return_index=True, return_inverse=True)
            counts = np.bincount(group, weights=weight, minlength=len(distinct)).astype(np.int64)
            for h, i, n in zip(distinct.tolist(), first.tolist(), counts.tolist(), strict=True):
                entry = known.get(h)
                if entry is None:
                    known[h] = [raw[s.start[i] : s.end[i]].translate(ASCII_LOWER), n]
                    size += int(s.end[i] - s.start[i])
                else:
                    entry[1] += n
            if len(known) > FLUSH_WORDS or size > FLUSH_BYTES:
                yield flush()
                size = 0
    if known:
        yield flush()


def _count_pieces(model: str):
    """Columns: word, n. How often each piece occurs in the words, once a task."""

    def run(batches):
        sp = processor(model)
        total = np.zeros(sp.vocab_size(), np.int64)
        for batch in batches:
            for first in range(0, len(batch), 20000):
                part = batch.slice(first, 20000)
                ids = sp.encode([w.decode("utf-8", "replace") for w in part.column(0).to_pylist()], num_threads=1)
                n = [len(x) for x in ids]
                flat = np.fromiter((i for x in ids for i in x), np.int64, sum(n))
                np.add.at(total, flat, np.repeat(part.column(1).to_numpy(), n))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

    return run


class Lattice:
    """Pieces as text, their log probabilities, and those of bytes."""

    def __init__(self, model: str, logs: np.ndarray):
        sp = processor(model)
        self.piece: dict[str, float] = {}
        self.byte = [_NO_PROB] * 256
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[1:-1], 16)] = float(logs[i])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.piece[sp.id_to_piece(i)] = float(logs[i])
        self.longest = max(map(len, self.piece))

    def __call__(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations."""
        text, piece, longest = MARKER + word, self.piece, self.longest
        exp, log, get = math.exp, math.log, piece.get
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            terms = []
            for begin in range(max(0, end - longest), end):
                p = get(text[begin:end])
                if p is not None:
                    terms.append(alpha[begin] + p)
            char = text[end - 1]
            if char not in piece:
                terms.append(alpha[end - 1] + sum(self.byte[b] for b in char.encode("utf-8", "replace")))
            most = max(terms)
            alpha.append(most + log(sum([exp(t - most) for t in terms])) if len(terms) > 1 else most)
        return alpha[-1]


def score_shares(model: str) -> np.ndarray:
    """Shares of a vocabulary's pieces by their scores; pieces without one (bytes, the end) rank behind all others."""
    sp = processor(model)
    size = sp.vocab_size()
    rank = np.array([size if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) else -sp.get_score(i) for i in range(size)])
    weight = 1 / (np.maximum(rank, 0) + ZIPF)
    return weight / weight.sum()


def piece_logs(counts: dict[int, int], shares: np.ndarray, ends: int, end_id: int) -> np.ndarray:
    """Log weights of all pieces, the end among them: counts, and the shares of the scores as ``PRIOR`` more."""
    n = np.zeros(len(shares))
    for i, c in counts.items():
        n[i] = c
    n[end_id] = ends
    return np.log((n + PRIOR * shares) / (n.sum() + PRIOR))


@functools.lru_cache(2)
def _lattice(model: str, logs: bytes) -> Lattice:
    return Lattice(model, np.frombuffer(logs))


def _word_logs(model: str, logs: bytes):
    """Columns: h, word, n. Adds the word's log10 probability."""

    def run(batches):
        lattice = _lattice(model, logs)
        for batch in batches:
            values = [lattice(w.decode("utf-8", "replace")) / math.log(10) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.float64())], names=["h", "n", "log"])

    return run


def _split(hot: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
    """Columns: id, copy, text. A row per document with the sums over hot words (h null), and rows for its others."""
    keys, known, base, log = hot

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(2)):
                h = s.word_hash(lower=True)
                doc = s.doc_of_word()
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                sums = [np.bincount(doc[found], weights=v[at[found]], minlength=s.n) for v in (known, base, log)]
                rare, owner = h[~found], doc[~found]
                pair = mix(rare + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, first, times = np.unique(pair, return_index=True, return_counts=True)
                rows = np.r_[np.arange(s.n), owner[first]] + s.rows[0]
                blank = np.zeros(len(first))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(rows)) for c in (0, 1)),
                        pa.array(np.r_[np.zeros(s.n, np.int64), signed(rare[first])], mask=np.arange(len(rows)) < s.n),
                        pa.array(np.r_[s.counts, times].astype(np.int64)),
                        pa.array(np.r_[sums[0].astype(np.int64), blank.astype(np.int64)]),
                        pa.array(np.r_[sums[1], blank]),
                        pa.array(np.r_[sums[2], blank]),
                    ],
                    names=["id", "copy", "h", "times", "known", "base", "log"],
                )

    return run


def lattice_scores(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", share: float = 2e-6) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("held_out", held_out("id"))
    copy = F.xxhash64("text").alias("copy")

    # 1. counts of words and pieces
    learn = (~F.col("held_out")).cast("int").alias("learn")
    words = rows.select(learn, "text").mapInArrow(_count_words, "h long, word binary, n long")
    words = written(words.groupBy("h", "word").agg(F.sum("n").alias("n")), "words")
    ends = rows.where(~F.col("held_out")).count()
    totals = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, distinct = (totals[0] or 0) + ends, (totals[1] or 0) + (1 if ends else 0)
    sp = processor(model)
    pieces = words.where("n > 0").select("word", "n").mapInArrow(_count_pieces(model), "piece int, n long")
    counts = {r["piece"]: r["n"] for r in pieces.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # a row per piece
    logs = piece_logs(counts, score_shares(model), ends, sp.eos_id())

    # 2. each word's values
    below = tokens + SMOOTHING * (distinct + 1)

    def base_log(n):
        return F.log10((n + F.lit(SMOOTHING)) / F.lit(below))

    valued = words.select("h", "word", "n").mapInArrow(_word_logs(model, logs.tobytes()), "h long, n long, log double")
    valued = written(valued.withColumn("base", base_log(F.col("n"))), "word-logs", batch_rows=10000)
    discard(words)
    often = max(1, math.ceil(share * tokens))  # so at most 1 / share words
    hot = valued.where(F.col("n") >= often).select("h", "n", "base", "log").toArrow()
    order = np.argsort(hot["h"].to_numpy().view(np.uint64))
    table = (
        hot["h"].to_numpy().view(np.uint64)[order],
        (hot["n"].to_numpy() > 0).astype(np.int64)[order],
        hot["base"].to_numpy()[order],
        hot["log"].to_numpy()[order],
    )

    # 3. documents
    schema = "id long, copy long, h long, times long, known long, base double, log double"
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def split(batches):
        yield from _split(shared.value)(batches)

    parts = rows.select("id", copy, "text").mapInArrow(split, schema)
    rare = valued.where(F.col("n") < often).select("h", F.col("n").alias("c"), F.col("base").alias("w_base"), F.col("log").alias("w_log"))
    joined = parts.where("h IS NOT NULL").select("id", "copy", "h", "times").join(rare, "h")
    own = parts.where("h IS NULL").select("id", "copy", (F.col("times") + 1).alias("n_tokens"), "known", "base", "log")
    more = joined.select(
        "id",
        "copy",
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.col("w_base")).alias("base"),
        (F.col("times") * F.col("w_log")).alias("log"),
    )
    sums = own.union(more).groupBy("id", "copy").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "log")))
    sums = written(sums, "sums")
    times = rows.groupBy("id", "held_out", F.xxhash64("text").alias("copy")).agg(F.count("*").alias("rows"))
    end_base = math.log10((ends + SMOOTHING) / below)
    end_log = float(logs[sp.eos_id()]) / math.log(10)
    joined = times.join(sums.select(F.col("id").alias("s_id"), F.col("copy").alias("s_copy"), "n_tokens", "known", "base", "log"), F.expr("id <=> s_id AND copy = s_copy"))
    return joined.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        F.col("id").alias("doc_id"),
        "held_out",
        (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("rows") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") + F.lit(end_base)).alias("base_score"),
        (F.col("log") / F.col("rows") + F.lit(end_log)).alias("score"),
    )
