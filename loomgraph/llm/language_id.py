"""Language of documents by a bidirectional gated recurrent network over bytes.

A text is read as bytes: A-Z lower-cased, bytes of other characters than ASCII as they are, each
run of anything else as one space. Two chains of gated units, one in each direction, run over the
text and give every byte position a distribution over languages. A document's probability pools the log
probabilities of all its positions but spaces: their mean, scaled by a power of their number.

States cross words and lines. To run many positions at once a text is cut into spans of ``SPAN``
bytes, each read together with ``CONTEXT`` bytes before and behind it, so a state that is older than the
context is dropped; every position of the whole text is labelled once. A long text takes memory
in proportion to its bytes, one at a time.

Trained here, in numpy by backpropagation through time, on windows from at most ``docs_per_language``
labelled documents of each of the ``languages`` most frequent languages, the same ones each time
(neither bound grows with the corpus). The scale and power of the pooling are fitted to
documents of that sample that the network didn't see, cut to many lengths, so that scores are
probabilities for short texts too.

Nulls: a text that is null or has no letters is ``und`` with score 0; documents without a
language are not learned from, a null id isn't held out. With nothing to learn from every text is
``und``. Of equal probabilities the first language by name counts. Ids may be null or repeated, rows
are independent, and equal texts are learned from once. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import pick
from .words import ragged, slices

SPAN, CONTEXT = 256, 16
#: Bytes of a window that the network is trained on, and windows of one document.
WINDOW, WINDOWS = 64, 12
DECAY = 2e-5
#: Spans that are run at a time; a span is filled up with spaces to a multiple of STEP bytes. Bytes of text held for that.
WIDTH, STEP, SLICE = 1024, 64, 4 << 20
_SPACE = 32
_SYMBOL = np.full(256, _SPACE, np.uint8)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def has_letters(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the network reads of texts that lie one behind the other, and where each begins (and the last ends)."""
    out = _SYMBOL[data]
    again = np.zeros(len(out), bool)
    again[1:] = (out[1:] == _SPACE) & (out[:-1] == _SPACE)
    again[bounds[:-1][bounds[:-1] < len(out)]] = False
    kept = np.r_[0, np.cumsum(~again)]
    return out[~again], kept[bounds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    scores = scores - scores.max(axis=-1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=-1, keepdims=True))


class BiGRU:
    """Gated recurrent units in both directions, a softmax at every position, and how positions are pooled.

    Inputs are symbols by position and text, (T, B).
    """

    def __init__(self, labels: list[str], hidden: int = 12, seed: int = 10, kind: type = np.float32):
        r = np.random.Generator(np.random.PCG64(seed))
        self.labels, self.hidden = labels, hidden
        k, h = len(labels), hidden
        self.p = {}
        for way in "fb":
            self.p["x" + way] = r.normal(0, 0.3, (256, 3 * h)).astype(kind)
            self.p["u" + way] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(kind)
            self.p["c" + way] = np.zeros(3 * h, kind)
        self.p["v"] = r.normal(0, 1 / np.sqrt(2 * h), (2 * h, k)).astype(kind)
        self.p["d"] = np.zeros(k, kind)
        self.scale, self.power = 1.0, 0.0

    def _taped(self, way: str, x: np.ndarray):
        """States by position, and all that their gradients need."""
        h = self.hidden
        wx, u, c = self.p["x" + way], self.p["u" + way], self.p["c" + way]
        state = np.zeros((x.shape[1], h), wx.dtype)
        states = np.zeros((*x.shape, h), wx.dtype)
        tape = []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            inputs = wx[x[t]] + c
            gates = _sigmoid(inputs[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            rs = r * state
            new = np.tanh(inputs[:, 2 * h :] + rs @ u[:, 2 * h :])
            tape.append((t, state, z, r, rs, new))
            state = states[t] = (1 - z) * state + z * new
        return states, tape

    def _states(self, way: str, x: np.ndarray) -> np.ndarray:
        """The same states, without a tape: signs and factors of the exponentials are folded into the weights."""
        h, n = self.hidden, x.shape[1]
        fold = np.r_[np.full(2 * h, -1), np.full(h, -2)].astype(np.float32)
        wx, u = (self.p["x" + way] + self.p["c" + way]) * fold, self.p["u" + way] * fold
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        wx_gates, wx_new = np.ascontiguousarray(wx[:, : 2 * h]), np.ascontiguousarray(wx[:, 2 * h :])
        states = np.empty((len(x), n, h), np.float32)
        state, gates, new, part = (np.zeros((n, w), np.float32) for w in (h, 2 * h, h, h))
        more = np.empty((n, 2 * h), np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
                np.take(wx_gates, x[t], axis=0, out=gates, mode="clip")
                np.matmul(state, u_gates, out=more)
                gates += more
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(gates[:, h:], state, out=part)
                np.take(wx_new, x[t], axis=0, out=new, mode="clip")
                new += part @ u_new
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                new -= state
                new *= gates[:, :h]
                state = np.add(state, new, out=states[t])
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities by position, text and label."""
        h, k = self.hidden, len(self.labels)
        scores = self._states("f", x).reshape(-1, h) @ self.p["v"][:h]
        scores += self._states("b", x).reshape(-1, h) @ self.p["v"][h:]
        scores += self.p["d"]
        scores -= np.log(np.exp(scores) @ np.ones((k, 1), scores.dtype))  # few and bounded: no exponential overflows
        return scores.reshape(*x.shape, k)

    def sums(self, read: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts by their symbols: log probabilities added up over their positions, and how many these are."""
        n = np.diff(bounds)
        spans = -(-n // SPAN)
        doc = np.repeat(np.arange(len(n)), spans)
        start = bounds[:-1][doc] + ragged(np.zeros(len(n), np.int64), spans) * SPAN
        size = np.minimum(bounds[1:][doc] - start, SPAN)
        out = np.zeros((len(n), len(self.labels)))
        counts = np.zeros(len(n), np.int64)
        steps = -(-size // STEP) * STEP  # only spans of one length are run together: what else there is plays no part
        order = np.argsort(steps, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(steps[order])) + 1)
        for at in (g[first : first + WIDTH] for g in groups for first in range(0, len(g), WIDTH)):
            here = start[at] + np.arange(-CONTEXT, int(steps[at[0]]) + CONTEXT)[:, None]
            outside = (here < bounds[doc[at]]) | (here >= bounds[doc[at] + 1])
            x = read[np.clip(here, 0, len(read) - 1)]
            x[outside] = _SPACE
            live = x != _SPACE
            live[:CONTEXT] = False
            live &= np.arange(len(x))[:, None] < CONTEXT + size[at]
            logs = self.positions(x)
            logs *= live[:, :, None]
            np.add.at(out, doc[at], logs.sum(axis=0))
            np.add.at(counts, doc[at], live.sum(axis=0))
        return out, counts

    def pooled(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = np.maximum(counts, 1)[:, None]
        return np.exp(_log_softmax(self.scale * n**self.power * sums / n))

    def gradients(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the labels over all positions but spaces."""
        h = self.hidden
        live = x != _SPACE
        ways = {w: self._taped(w, x) for w in "fb"}
        both = np.concatenate([ways[w][0] for w in "fb"], axis=2)
        delta = np.exp(_log_softmax(both @ self.p["v"] + self.p["d"]))
        delta[:, np.arange(x.shape[1]), label] -= 1
        delta *= (live / max(live.sum(), 1)).astype(delta.dtype)[:, :, None]
        flat = delta.reshape(-1, delta.shape[2])
        g = {"v": both.reshape(-1, 2 * h).T @ flat, "d": flat.sum(axis=0)}
        back = delta @ self.p["v"].T
        order = np.argsort(x.ravel(), kind="stable")
        kinds, begins = np.unique(x.ravel()[order], return_index=True)
        for w, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            u = self.p["u" + w]
            carry = np.zeros((x.shape[1], h), u.dtype)
            gu, inputs = np.zeros_like(u), np.zeros((*x.shape, 3 * h), u.dtype)
            for t, state, z, r, rs, new in reversed(ways[w][1]):
                d = carry + part[t]
                dn = d * z * (1 - new * new)
                drs = dn @ u[:, 2 * h :].T
                dg = np.concatenate([d * (new - state) * z * (1 - z), drs * state * r * (1 - r)], axis=1)
                gu[:, : 2 * h] += state.T @ dg
                gu[:, 2 * h :] += rs.T @ dn
                inputs[t, :, : 2 * h], inputs[t, :, 2 * h :] = dg, dn
                carry = d * (1 - z) + drs * r + dg @ u[:, : 2 * h].T
            inputs = inputs.reshape(-1, 3 * h)
            g["u" + w], g["c" + w] = gu, inputs.sum(axis=0)
            g["x" + w] = np.zeros_like(self.p["x" + w])
            g["x" + w][kinds] = np.add.reduceat(inputs[order], begins, axis=0)
        return g

    def fit(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 240, batch: int = 128) -> BiGRU:
        """Adam over windows (WINDOW, n) drawn by weight."""
        r = np.random.Generator(np.random.PCG64(11))
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        odds = np.cumsum(weight / weight.sum())
        for step in range(1, steps + 1):
            at = np.minimum(np.searchsorted(odds, r.random(batch)), x.shape[1] - 1)
            g = self.gradients(x[:, at], label[at])
            rate = 0.015 * min(1, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                g[k] += DECAY * self.p[k]
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.999 * two[k] + 0.001 * g[k] ** 2
                self.p[k] -= (rate * one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(self.p[k].dtype)
        return self

    def calibrate(self, texts: list[bytes], label: np.ndarray) -> BiGRU:
        """Scale and power of the pooling by the least loss on texts."""
        read = np.frombuffer(b"".join(texts), np.uint8)
        sums, counts = self.sums(read, np.r_[0, np.cumsum([len(t) for t in texts])])
        best = np.inf
        for power in (0.0, 0.25, 0.5, 0.75, 1.0):
            for scale in 2.0 ** np.arange(-4, 7.5, 0.5):
                self.scale, self.power = scale, power
                loss = -np.log(np.maximum(self.pooled(sums, counts)[np.arange(len(label)), label], 1e-300)).mean()
                if loss < best - 1e-9:
                    best, found = loss, (scale, power)
        self.scale, self.power = found
        return self


def _windows(data: bytes, seed: int) -> list[bytes]:
    """Windows of one text's symbols, from anywhere in it, with the spaces that stand around a text when it is read."""
    r = np.random.Generator(np.random.PCG64(seed))
    n = min(WINDOWS, 1 + -(-len(data) // WINDOW))
    padded = b" " * CONTEXT + data + b" " * max(CONTEXT, WINDOW - len(data))
    return [padded[a : a + WINDOW] for a in np.sort(r.integers(0, len(padded) - WINDOW + 1, n)).tolist()]


def _training_rows(batches):
    """Columns: lang, copy, text. The windows of each text."""
    for batch in batches:
        for s in slices(batch.column(2)):
            read, ptr = symbols(s.data, s.bounds)
            copies = batch.column(1).slice(s.rows[0], s.n).to_pylist()
            rows = [_windows(read[a:b].tobytes(), c & 0xFFFFFFFF) for a, b, c in zip(ptr[:-1], ptr[1:], copies, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(s.rows[0], s.n) for c in (0, 1)), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "copy", "windows"]
            )


def train(rows: list[tuple[str, list[bytes]]], spare: int = 5) -> BiGRU | None:
    """rows: (language, windows of a document, of WINDOW bytes each). Every ``spare``-th document of a language is for the pooling alone."""
    rows = [(lang, some) for lang, windows in rows if (some := [w for w in windows if w.strip()])]
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    place = {k: i for i, k in enumerate(labels)}
    seen = dict.fromkeys(labels, 0)
    learn: list[tuple[int, bytes, float]] = []
    hold: list[tuple[int, bytes]] = []
    r = np.random.Generator(np.random.PCG64(12))
    for lang, windows in rows:
        seen[lang] += 1
        if seen[lang] % spare:
            learn += [(place[lang], w, 1 / len(windows)) for w in windows]
        else:
            some = [b" ".join(windows), *windows[:2], windows[-1].strip()[: int(r.integers(4, WINDOW))]]
            hold += [(place[lang], w) for w in some if w.strip()]
    label = np.array([x[0] for x in learn])
    x = np.frombuffer(b"".join(w for _, w, _ in learn), np.uint8).reshape(-1, WINDOW)
    weight = np.array([x[2] for x in learn])
    weight /= np.bincount(label, weights=weight, minlength=len(labels))[label]
    model = BiGRU(labels).fit(np.ascontiguousarray(x.T), label, weight)
    return model.calibrate([w for _, w in hold], np.array([k for k, _ in hold])) if hold else model


def sample(docs: DataFrame, per_language: int, languages: int) -> DataFrame:
    """docs(doc_id, text, lang) -> lang, copy and windows of about twice ``per_language`` documents of each language.

    A document is chosen by the hash of its id and text, against a threshold from the count of its language: no
    task ranks the documents of a language. Equal rows are one.
    """
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    chosen = F.lit(False)
    copy = F.xxhash64("doc_id", "text")
    if counts:
        below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_language / r["n"]))])
        chosen = copy / 2.0**64 + 0.5 < F.try_element_at(below, F.col("lang"))
    some = docs.where(chosen).select("lang", copy.alias("copy"), "text")
    rows = some.mapInArrow(_training_rows, "lang string, copy long, windows array<binary>")
    return rows.groupBy("lang", "copy").agg(F.min("windows").alias("windows"))


def _predict(model: BiGRU | None):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1), SLICE):
                pred, score = np.full(s.n, "und", object), np.zeros(s.n)
                read, ptr = symbols(s.data, s.bounds)
                ascii_letter = np.r_[0, np.cumsum((read != _SPACE) & (read < 128))][ptr]
                other = np.r_[0, np.cumsum(read >= 128)][ptr]
                some = np.diff(ascii_letter) > 0
                raw = s.raw()
                for d in np.flatnonzero(~some & (np.diff(other) > 0)).tolist():
                    some[d] = has_letters(raw[s.bounds[d] : s.bounds[d + 1]])
                if model and some.any():
                    odds = model.pooled(*model.sums(read, ptr))[some]
                    best = odds.argmax(axis=1)
                    pred[some] = np.array(model.labels, object)[best]
                    score[some] = np.minimum(odds[np.arange(len(odds)), best], 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.rows[0], s.n), pa.array(pred.tolist(), pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"],
                )

    return run


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 400,
    languages: int = 256,
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score (its probability). Learns from rows that aren't held out."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    learn = rows.where(~held_out()).where("lang IS NOT NULL AND text IS NOT NULL")
    chosen = sorted((r["lang"], r["copy"], r["windows"]) for r in sample(learn, docs_per_language, languages).collect())
    taken: dict[str, int] = {}
    few = []
    for lang, _, windows in chosen:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= docs_per_language:
            few.append((lang, [bytes(w) for w in windows]))
    model = train(few)
    out = rows.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
