"""Toxicity by a chain of linear classifiers.

The categories are predicted in order. Each has a logistic model on the words of a text
(lower-cased A-Z, ASCII punctuation at their ends off, present or not, scaled by
their naive Bayes log ratio: Wang, Manning 2012) and on the log odds of all categories
before it. For training, those come from models that did not see the document (``folds``
out-of-fold parts); for scoring, from the models of the whole sample. The last category's
threshold is where its out-of-fold predictions have the best F1.

The models are fitted on about ``sample`` labelled documents, the same ones each time, and on at most
``DOCUMENT_WORDS`` distinct words of each; they are a few thousand weights, and every text is scored whole, in
one pass. Categories should tell documents apart in different ways: one that follows from those before it adds nothing.

Nulls: a null text has no words and gets the scores of an empty one; labels with a null
are not learned from, of several for one id the largest counts. With no labels of both
kinds a category's probability is its share (0 without labels). Ids may be null or
repeated: rows are independent, and of rows that repeat a labelled id the text of the smallest hash is
learned from. A probability that equals the threshold is toxic. Very long texts are taken one at a
time. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import hash_sample, pick
from .words import signed, slices

#: Words that a model keeps: those whose presence differs most between the classes.
FEATURES = 4096
#: Distinct words of a document that are learned from, those of the smallest hashes.
DOCUMENT_WORDS = 4096
#: Standard deviations that a word's presence differs by, at least: fewer are likely chance.
DEVIATIONS = 4.0
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(s) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each document of a slice, distinct, and where each document's begin."""
    start, end = s.start.copy(), s.end.copy()
    for _ in range(4):
        end -= _PUNCTUATION[s.data[end - 1]] & (end - start > 1)
        start += _PUNCTUATION[s.data[np.minimum(start, len(s.data) - 1)]] & (end - start > 1)
    h, doc = s.spans(start, end, lower=True)[0], s.doc_of_word()
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(s.n + 1))


def _training_rows(batches):
    """Columns: id, text, copy. The features of each text; they are in the order of their hashes."""
    for batch in batches:
        for s in slices(batch.column(1)):
            x, ptr = features(s)
            kept = np.arange(len(x)) - np.repeat(ptr[:-1], np.diff(ptr)) < DOCUMENT_WORDS
            ptr = np.r_[0, np.cumsum(kept)][ptr]
            lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(signed(x[kept])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.rows[0], s.n) for c in (0, 2)), lists], names=["id", "copy", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Linear:
    """weight by feature, bias, and a weight for each category before."""

    def __init__(self, weight: np.ndarray, bias: float, before: np.ndarray):
        self.weight, self.bias, self.before = weight, bias, before

    def predict(self, x: np.ndarray, ptr: np.ndarray, odds: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(x) + 1)
        np.cumsum(self.weight[x], out=sums[1:])
        return _sigmoid(sums[ptr[1:]] - sums[ptr[:-1]] + self.bias + odds @ self.before)


def fit_linear(x: np.ndarray, ptr: np.ndarray, odds: np.ndarray, y: np.ndarray, size: int, steps: int = 120, ridge: float = 1e-3) -> Linear:
    n, k = len(y), odds.shape[1]
    zero = np.zeros(size)
    if not 0 < y.sum() < n:
        share = y.mean() if n else 0.0
        return Linear(zero, float(_log_odds(np.array(share))) if 0 < share < 1 else (30.0 if share else -30.0), np.zeros(k))
    doc = np.repeat(np.arange(n), np.diff(ptr))
    here = np.bincount(x, weights=y[doc], minlength=size)
    seen = np.bincount(x, minlength=size)
    p, q = (here + 0.5) / (y.sum() + 1), (seen - here + 0.5) / (n - y.sum() + 1)
    mean = np.clip(seen / n, 1e-9, 1 - 1e-9)
    spread = np.sqrt(mean * (1 - mean) * (1 / y.sum() + 1 / (n - y.sum())))
    apart = np.where(seen >= 3, np.abs(p - q) / spread, 0)
    chosen = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
    chosen = chosen[apart[chosen] >= DEVIATIONS]
    column = np.full(size, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[x] >= 0
    rows, cols = doc[keep], column[x[keep]]
    scale = np.log(p / q)[chosen]
    w = np.zeros(len(chosen) + k + 1)
    one, two = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=(w[: len(chosen)] * scale)[cols], minlength=n) + odds @ w[len(chosen) : -1] + w[-1]
        e = (_sigmoid(z) - y) / n
        g = np.r_[np.bincount(cols, weights=e[rows], minlength=len(chosen)) * scale, odds.T @ e, e.sum()]
        g[:-1] += ridge * w[:-1] / n * 100
        one = 0.9 * one + 0.1 * g
        two = 0.999 * two + 0.001 * g * g
        w -= 0.05 * one / (1 - 0.9**step) / (np.sqrt(two / (1 - 0.999**step)) + 1e-9)
    weight = zero
    weight[chosen] = w[: len(chosen)] * scale
    return Linear(weight, float(w[-1]), w[len(chosen) : -1])


def _rows_of(x: np.ndarray, ptr: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(ptr)[at]
    parts = [x[ptr[i] : ptr[i + 1]] for i in at]
    return (np.concatenate(parts) if parts else x[:0]), np.r_[0, np.cumsum(n)]


class Chain:
    """One linear model for each category over the words that any of them weighs, and the last one's threshold."""

    def __init__(self, models: list[Linear], vocabulary: np.ndarray, threshold: float):
        kept = np.zeros(len(vocabulary), bool)
        for m in models:
            kept |= m.weight != 0
        self.words, self.threshold = vocabulary[kept], threshold
        self.models = [Linear(m.weight[kept], m.bias, m.before) for m in models]

    def predict(self, x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, x)
        known = np.append(self.words, np.uint64(0))[at] == x if len(self.words) else np.zeros(len(x), bool)
        known &= at < len(self.words)
        x, ptr = at[known], np.r_[0, np.cumsum(known)][ptr]
        out = np.zeros((len(ptr) - 1, 0))
        for m in self.models:
            out = np.column_stack([out, m.predict(x, ptr, _log_odds(out))])
        return out


def fit_chain(words: np.ndarray, ptr: np.ndarray, labels: np.ndarray, folds: int = 3) -> Chain:
    vocabulary, x = np.unique(words, return_inverse=True)
    n, size = len(ptr) - 1, len(vocabulary)
    fold = np.arange(n) % folds
    odds, models = np.zeros((n, 0)), []
    last = np.zeros(n)
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        last = np.zeros(n)
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            m = fit_linear(*_rows_of(x, ptr, inside), odds[inside], y[inside], size)
            last[outside] = m.predict(*_rows_of(x, ptr, outside), odds[outside])
        models.append(fit_linear(x, ptr, odds, y, size))
        odds = np.column_stack([odds, _log_odds(last)])
    return Chain(models, vocabulary, _threshold(last, labels[:, -1] > 0) if n else 0.5)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    grid = np.linspace(0.05, 0.95, 91)
    hits = np.array([(p[y] >= t).sum() for t in grid])
    flagged = np.array([(p >= t).sum() for t in grid])
    f1 = 2 * hits / np.maximum(flagged + y.sum(), 1)
    best = grid[f1 >= f1.max() - 1e-12]
    return float(best[len(best) // 2]) if f1.max() > 0 else 0.5


def _score(chain: Chain):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                p = chain.predict(*features(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.rows[0], s.n), *(pa.array(p[:, c]) for c in range(p.shape[1]))],
                    names=["doc_id", *(f"p{c}" for c in range(p.shape[1]))],
                )

    return run


def learn(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", sample: int = 12000
) -> Chain:
    """The chain of the categories (name -> SQL condition on a row of labels), in their order."""
    conditions = F.array(*(F.expr(f"CAST({c} AS INT)") for c in categories.values()))
    known = labels.select(F.col(f"`{label_id_col}`").alias("id"), conditions.alias("labels"))
    known = hash_sample(known.where("id IS NOT NULL AND NOT exists(labels, x -> x IS NULL)"), ["id"], sample)
    merged = known.groupBy("id").agg(*(F.max(F.col("labels")[i]).alias(f"l{i}") for i in range(len(categories))))
    merged = merged.select("id", F.array(*(f"l{i}" for i in range(len(categories)))).alias("labels"))
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(merged.select("id")), "id", "left_semi")  # about sample ids
    seen = texts.select("id", "text", F.xxhash64("text").alias("copy")).mapInArrow(_training_rows, "id long, copy long, x array<long>")
    one = seen.groupBy("id").agg(F.min_by("x", "copy").alias("x"))
    rows = one.join(F.broadcast(merged), "id").toArrow().sort_by("id")
    lists = rows["x"].combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ptr = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    return fit_chain(x, ptr, np.array(rows["labels"].to_pylist(), np.int64).reshape(-1, len(categories)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    sample: int = 12000,
) -> DataFrame:
    """categories: see :func:`learn`. Per row: doc_id, p_<name> for each, and toxic: whether the last one's
    probability reaches the threshold."""
    chain = learn(docs, labels, categories, id_col, text_col, label_id_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches):
        yield from _score(shared.value)(batches)

    schema = "doc_id long, " + ", ".join(f"p{c} double" for c in range(len(categories)))
    out = pick(docs, id=id_col, text=text_col).mapInArrow(score, schema)
    return out.select(
        "doc_id",
        *(F.col(f"p{i}").alias(f"p_{name}") for i, name in enumerate(categories)),
        (F.col(f"p{len(categories) - 1}") >= chain.threshold).alias("toxic"),
    )
