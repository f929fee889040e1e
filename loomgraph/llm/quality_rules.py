"""Quality rules: counts within a document, and lines that many documents of a host share.

Within a document (words ``[^\\x20\\x09-\\x0D]+``): code points in words, symbols
``[#*$%&|<>]``, lines with a word that equal an earlier line, and words in
8-word windows that occur twice or more. A document fails these when it has
fewer than ``min_words`` words or more than ``max_repeat`` percent repeated ones.

Across documents: a line is normalised (A-Z lower-cased, words joined by one space)
and hashed; for each host and line the distinct documents are counted, copies of a
text once. A line found in more than ``line_limit`` documents and ``line_share`` percent
of a host's is removed, except from the first (smallest id) that holds it, and a
document with fewer than ``min_left`` percent of its words left is depleted.
Copies of one text are one document in these counts: a page copied a thousand times
is for the duplicate operators, not here. :func:`quality_rules` gives the counts and verdicts,
:func:`without_common_lines` the kept documents and their texts without the removed lines.

The counting groups by (host, line), reduced before the shuffle; the hot lines come
back to documents through a join that can be split, and per document only sums travel.

Nulls: a null text has no words; a null host is a host of its own; a null id is
returned as it is, and its row isn't a line's first where another holds the line. Rows that repeat id, host and text are one row's copies, each
returned. Very long texts are taken one at a time, in memory in proportion to their bytes. Other
columns are not read; :func:`without_common_lines` returns them, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, pick, written
from .words import IS_SPACE, digests, mix, per_doc, signed, slices

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_STARTS_POINT = (np.arange(256) & 0xC0) != 0x80
_IN_WORD = _STARTS_POINT & ~IS_SPACE


def _lines(s):
    """Of each line with a word: its document, bytes (start, end), words (first, last) and number in the document."""
    breaks = np.flatnonzero(s.data == 10)
    start = np.union1d(breaks + 1, s.bounds[:-1])
    start = start[start < len(s.data)]
    end = np.minimum(np.r_[start[1:], len(s.data)], len(s.data))
    first, last = np.searchsorted(s.start, start), np.searchsorted(s.start, end)
    some = last > first
    start, end, first, last = start[some], end[some], first[some], last[some]
    end = end - (s.data[end - 1] == 10)
    doc = np.searchsorted(s.bounds, start, side="right") - 1
    return doc, start, end, first, last, np.searchsorted(breaks, start) - np.searchsorted(breaks, s.bounds[doc])


def _key(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _repeated(s, words: np.ndarray) -> np.ndarray:
    """Whether each word is in a window that its document holds twice or more."""
    first, h = s.grams(words, REPEAT_WINDOW)
    _, group, n = np.unique(_key(np.searchsorted(s.ptr, first, side="right") - 1, h), return_inverse=True, return_counts=True)
    at = first[n[group] > 1]
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + REPEAT_WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batches):
    """Columns: id, text."""
    for batch in batches:
        for s in slices(batch.column(1)):
            words = s.word_hash()
            doc, start, end, *_ = _lines(s)
            same = digests(s.parts(start, end))
            _, first = np.unique(_key(doc, same), return_index=True)
            again = np.ones(len(doc), bool)
            again[first] = False
            values = [
                s.counts,
                per_doc(_IN_WORD[s.data], s.bounds),
                per_doc(_SYMBOL[s.data], s.bounds),
                np.bincount(doc[again], minlength=s.n),
                per_doc(_repeated(s, words), s.ptr),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.rows[0], s.n), *(pa.array(v.astype(np.int64)) for v in values)], names=["doc_id", *_COUNTS]
            )


def _line_rows(batches):
    """Columns: id, host, copy, text. For each row and distinct line: how many words it has there, and which lines it is."""
    for batch in batches:
        for s in slices(batch.column(3)):
            doc, start, end, first, last, number = _lines(s)
            h = digests([b" ".join(line.split()) for line in s.parts(start, end, lower=True)])
            _, at, group = np.unique(_key(doc, h), return_index=True, return_inverse=True)
            total = np.bincount(group, weights=last - first, minlength=len(at)).astype(np.int64)
            bounds = np.r_[0, np.cumsum(np.bincount(group, minlength=len(at)))].astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(bounds), pa.array(number[np.argsort(group, kind="stable")].astype(np.int32)))
            rows = pa.array(s.rows[0] + doc[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in range(3)), pa.array(signed(h[at])), pa.array(total), places],
                names=["id", "host", "copy", "line", "words", "places"],
            )


def _judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat: int = 30,
    line_limit: int = 100,
    line_share: int = 5,
    min_left: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts per row with its host and copy, and by (g_id, g_host, g_copy) the words and numbers of the removed lines."""
    source = pick(docs, id=id_col, text=text_col, host=host_col).withColumn("copy", F.xxhash64("text"))
    lines = source.select("id", "host", "copy", "text").mapInArrow(_line_rows, "id long, host string, copy long, line long, words long, places array<int>")
    lines = written(lines, "lines")
    texts = lines.groupBy("host", "copy").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("texts"))
    per_copy = lines.groupBy("host", "line", "copy").agg(F.min("id").alias("first"))
    common = per_copy.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    common = common.where(F.col("n") > line_limit).alias("c").join(texts.alias("t"), F.expr("c.host <=> t.host"))
    common = common.where(100 * F.col("n") > line_share * F.col("texts")).select("c.host", "line", "first")
    gone = (
        lines.alias("l")
        .join(common.alias("c"), F.expr("l.host <=> c.host AND l.line = c.line AND NOT l.id <=> c.first"))
        .select("l.id", "l.host", "l.copy", "l.line", "words", "places")
        .dropDuplicates(["id", "host", "copy", "line"])
        .groupBy("id", "host", "copy")
        .agg(F.sum("words").alias("n_line_words"), F.flatten(F.collect_list("places")).alias("gone_lines"))
        .select(*(F.col(c).alias(f"g_{c}") for c in ("id", "host", "copy")), "n_line_words", "gone_lines")
    )
    gone = written(gone, "common-lines")
    discard(lines)
    schema = "row struct<id:long,host:string,copy:long>, " + ", ".join(f"{c} long" for c in _COUNTS)
    counts = source.select(F.struct("id", "host", "copy").alias("row"), "text").mapInArrow(_measure, schema)
    verdicts = (
        counts.select(F.col("row.id").alias("doc_id"), F.col("row.host").alias("host"), F.col("row.copy").alias("copy"), *_COUNTS)
        .join(gone, F.expr("doc_id <=> g_id AND host <=> g_host AND copy = g_copy"), "left")
        .select("doc_id", "host", "copy", *_COUNTS, F.coalesce("n_line_words", F.lit(0)).alias("n_line_words"))
        .withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words"))
        .withColumn("depleted", F.expr(f"n_words > 0 AND 100 * (n_words - n_line_words) < {min_left} * n_words"))
        .withColumn("kept", F.expr("NOT base_failed AND NOT depleted"))
    )
    return verdicts, gone


def quality_rules(docs: DataFrame, **rules) -> DataFrame:
    """Per row: doc_id, the five counts, base_failed, n_line_words (words in removed lines), depleted and kept."""
    return _judge(docs, **rules)[0].drop("host", "copy")


def without_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", added: str = "n_line_words", **rules
) -> DataFrame:
    """The kept rows in their columns, without the removed lines in their texts, and column ``added``: words in these lines."""
    verdicts, gone = _judge(docs, id_col, text_col, host_col, **rules)
    kept = verdicts.where("kept").select("doc_id", "host", "copy").distinct()
    kept = kept.join(gone, F.expr("doc_id <=> g_id AND host <=> g_host AND copy = g_copy"), "left")
    kept = kept.select(*(F.col(c).alias(f"k_{c}") for c in ("doc_id", "host", "copy")), "n_line_words", "gone_lines")
    # written first: the verdicts' Python code and the join of whole texts don't share an executor's memory
    kept = written(kept, "kept-rows")
    discard(gone)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{host_col}`").cast("string").alias("host"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("copy"),
    )
    # rows grow with the corpus: the same join at every size
    rows = rows.join(kept.hint("merge"), F.expr("id <=> k_doc_id AND host <=> k_host AND copy = k_copy"))
    text = F.col("row").getField(text_col)
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone_lines", i)), "\n")
    text = F.when(F.col("gone_lines").isNull(), text).otherwise(left)
    columns = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*columns, F.coalesce("n_line_words", F.lit(0)).alias(added))
