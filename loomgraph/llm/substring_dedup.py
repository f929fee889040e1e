"""Removal of repeated word spans by a compacted De Bruijn graph.

A window is ``window`` consecutive words of one document. A word goes if a window
that covers it has a word sequence that also starts earlier: in a document of a
smaller id, or earlier in the same one.

1. Of the k-mers (k just over half a window) of each window the one with the
   smallest hash is its *anchor*. Equal windows have equal anchors, so only
   anchors, about one position in six, are counted across documents.
2. Anchors of two documents or more, each at its first place in a document, are the
   graph's nodes. Two that follow each other in
   a document at most k words apart are an edge; their words leave no gap, so the
   edge fixes the words between them. A node whose occurrences all have one
   successor (predecessor) does not branch. Joining occurrences with their nodes
   compacts chains of unbranched edges into paths.
3. An occurrence of a path other than its first is a repeat as a whole. Source
   coordinates decide which one is first.
4. Windows at the ends of paths, across branches and on first occurrences are
   grouped by a 128-bit hash of their words and settled one by one; those that
   stood earlier in the same document are found there, without a shuffle.

Groups are only ever counted or reduced to a minimum before a shuffle, and joins
against them can be split where one key is frequent.

Nulls: a null text has no words. Rows whose id is null or repeated come after all others,
in the order of a hash of id and text; those that are equal count as one document, and each
gets its result. Texts shorter than a window lose nothing; a very long one is a slice of its
own, so it takes memory in proportion to its bytes. Other columns are not read, whatever their names.

A path of two anchors or more is a repeat only if the hashes of both, and their distance, occur
elsewhere: 128 bits in all. All other windows are settled by two independent hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, pick, row_key, written
from .words import Slice, mix, per_doc, runs, signed, slices

def _windows(s: Slice, words: np.ndarray, window: int, k: int):
    """Starts of all windows, and the place of each one's anchor, with the k-mers' hashes."""
    n = len(words)
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    grams = runs(words, k)
    width = window - k + 1
    least = grams[: n - window + 1].copy()
    for o in range(1, width):
        np.minimum(least, grams[o : o + len(least)], out=least)
    at = np.zeros(len(least), np.int64)
    for o in range(width - 1, -1, -1):
        at[grams[o : o + len(least)] == least] = o
    start = np.flatnonzero(np.arange(len(least)) + window <= np.repeat(s.ptr[1:], s.counts)[: len(least)])
    return start, start + at[start], grams


def _again(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the same hash stood earlier in the same document."""
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    out = np.ones(len(h), bool)
    out[first] = False
    return out


def _anchors(window: int, k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(1)):
                start, anchor, grams = _windows(s, s.word_hash(), window, k)
                if not len(start):
                    continue
                anchor = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                doc = np.searchsorted(s.ptr, anchor, side="right") - 1
                h = grams[anchor]
                new = ~_again(doc, h)  # a document counts once
                h, doc, anchor = h[new], doc[new], anchor[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h)),
                        pa.array(ids[s.rows[0] + doc]),
                        pa.array((anchor - s.ptr[doc]).astype(np.int32)),
                    ],
                    names=["h", "id", "pos"],
                )

    return run


def _lists(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of rows first..last of a list column; null is empty."""
    part = column.slice(first, last - first)
    counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return part.flatten().to_numpy(zero_copy_only=False), counts


def _marked(length: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in one of the spans [low, high)."""
    steps = np.bincount(low, minlength=length + 1) - np.bincount(high, minlength=length + 1)
    return np.cumsum(steps[:-1]) > 0


def _open_windows(window: int, k: int):
    """Windows on a repeated anchor that no repeated path holds."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(1)):
                words, other = s.spans(s.start, s.end)
                start, anchor, grams = _windows(s, words, window, k)
                if not len(start):
                    continue
                n = len(words)
                low, counts = _lists(batch.column(2), *s.rows)
                high, _ = _lists(batch.column(3), *s.rows)
                repeat, _ = _lists(batch.column(4), *s.rows)
                base = np.repeat(s.ptr[:-1], counts)
                limit = np.repeat(s.ptr[1:], counts)
                low, high, repeat = np.minimum(base + low, limit), np.minimum(base + high, limit), repeat.astype(bool)
                known = _marked(n, low, np.minimum(high + 1, limit))
                own = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                known[own[_again(np.searchsorted(s.ptr, own, side="right") - 1, grams[own])]] = True
                whole = repeat & (high + k - low >= window)
                done = _marked(n, low[whole], np.minimum(high[whole] + k, limit[whole]) - window + 1)
                keep = known[anchor] & ~done[start]
                start = start[keep]
                if not len(start):
                    continue
                doc = np.searchsorted(s.ptr, start, side="right") - 1
                h = runs(words, window)[start]
                new = ~_again(doc, h)  # _cut settles those that stood in the same document
                start, doc, h = start[new], doc[new], h[new]
                check = runs(other, window)[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h)),
                        pa.array(signed(check)),
                        pa.array(ids[s.rows[0] + doc]),
                        pa.array((start - s.ptr[doc]).astype(np.int32)),
                    ],
                    names=["h", "check", "id", "pos"],
                )

    return run


def _cut(window: int, k: int):
    """Columns: id, text, low, high, repeat (paths), pos (windows). Finds repeats within a document itself."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                n = len(s.start)
                limit = s.ptr[1:]
                low, counts = _lists(batch.column(2), *s.rows)
                high, _ = _lists(batch.column(3), *s.rows)
                repeat, _ = _lists(batch.column(4), *s.rows)
                base, end = np.repeat(s.ptr[:-1], counts), np.repeat(limit, counts)
                low, high = np.minimum(base + low, end), np.minimum(base + high + k, end)
                whole = repeat.astype(bool) & (high - low >= window)
                pos, places = _lists(batch.column(5), *s.rows)
                first = np.repeat(s.ptr[:-1], places) + pos
                first = first[first + window <= np.repeat(limit, places)]
                start, h = s.grams(s.word_hash(), window)
                first = np.r_[first, start[_again(np.searchsorted(s.ptr, start, side="right") - 1, h)]]
                gone = _marked(n, np.r_[low[whole], first].astype(np.int64), np.r_[high[whole], first + window].astype(np.int64))
                raw = s.data.tobytes()
                removed = per_doc(gone, s.ptr)
                kept = []
                spans: list[list[dict]] = []
                for d in range(s.n):
                    a, b = s.ptr[d], s.ptr[d + 1]
                    words = raw[s.bounds[d] : s.bounds[d + 1]].split()
                    out: list[dict] = []
                    if removed[d]:
                        g = gone[a:b]
                        words = [words[i] for i in np.flatnonzero(~g)]
                        edge = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0]))
                        out = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    kept.append(b" ".join(words))
                    spans.append(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(s.rows[0], s.n),
                        pa.array(s.counts.astype(np.int64)),
                        pa.array(removed),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (words joined by one space) and the removed spans of words."""
    k = window // 2 + 1
    source = pick(docs, doc_id=id_col, text=text_col)
    source = source.withColumn("id", row_key(source, "doc_id", "text"))
    texts = source.select("id", "text")

    # 1. anchors that occur twice or more
    anchors = texts.mapInArrow(_anchors(window, k), "h long, id long, pos int")
    nodes = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    seen = written(anchors.join(nodes, "h"), "anchors")

    # 2. edges, branches and paths
    in_doc = Window.partitionBy("id").orderBy("pos")
    gap = F.lead("pos").over(in_doc) - F.col("pos")
    before = F.col("pos") - F.lag("pos").over(in_doc)
    edges = (
        seen.groupBy("id", "pos")
        .agg(F.min("h").alias("h"))
        .withColumn("next", F.when(gap <= k, F.xxhash64(F.lead("h").over(in_doc), gap)).otherwise(F.lit(0)))
        .withColumn("prev", F.when(before <= k, F.xxhash64(F.lag("h").over(in_doc), before)).otherwise(F.lit(0)))
    )
    edges = written(edges, "edges")
    discard(seen)
    branch = edges.groupBy("h").agg(
        F.min("id").alias("first_id"),
        (F.min("next") == F.max("next")).alias("one_next"),
        (F.min("prev") == F.max("prev")).alias("one_prev"),
    )
    steps = edges.join(branch, "h").select(
        "id", "pos", "one_next", "one_prev", "next", (F.col("id") != F.col("first_id")).alias("repeat")
    )
    joined = (
        F.lag("one_next").over(in_doc)
        & F.col("one_prev")
        & (F.lag("next").over(in_doc) != 0)
        & (F.lag("repeat").over(in_doc) == F.col("repeat"))
    )
    paths = (
        steps.withColumn("begins", F.when(joined, 0).otherwise(1))
        .withColumn("path", F.sum("begins").over(in_doc))
        .groupBy("id", "path")
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.max("repeat").alias("repeat"))
        .groupBy("id")
        .agg(F.collect_list(F.struct("low", "high", "repeat")).alias("paths"))
        .select("id", *(F.col(f"paths.{c}").alias(c) for c in ("low", "high", "repeat")))
    )
    paths = written(paths, "paths")
    discard(edges)

    # 3. single windows
    schema = "h long, check long, id long, pos int"
    windows = texts.join(paths, "id").select("id", "text", "low", "high", "repeat").mapInArrow(_open_windows(window, k), schema)
    windows = written(windows, "windows")
    first = windows.groupBy("h", "check").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    repeats = (
        windows.join(first, ["h", "check"])
        .where("id != first_id")
        .groupBy("id")
        .agg(F.collect_set("pos").alias("pos"))
    )
    marks = written(paths.join(repeats, "id", "left"), "marks")
    discard(windows, paths)

    # 4. the texts without them
    return (
        source.join(marks, "id", "left")
        .select("doc_id", "text", "low", "high", "repeat", "pos")
        .mapInArrow(
            _cut(window, k),
            "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>",
        )
    )
