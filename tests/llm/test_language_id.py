import random
import zlib

import numpy as np

from loomgraph.llm import language_id
from loomgraph.llm.language_id import BiGRU, identify, sample, symbols, train

VOCAB = {
    "aa": ["thing", "that", "over", "the", "with"],
    "bb": ["ñando", "ción", "pero", "esta", "los"],
    "cc": ["über", "schön", "das", "nicht", "ein"],
}


def make(n):
    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(VOCAB))
        rows.append((i, " ".join(r.choice(VOCAB[lang]) + r.choice(["", ".", "!", "1"]) for _ in range(r.randint(1, 30))), lang))
    return rows


def read(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return symbols(data, np.array([0, len(data)]))[0]


def test_symbols():
    assert read("The  2 Öäx--y\n").tobytes() == "the Öäx y ".encode()
    both = np.frombuffer(b"a  . b", np.uint8)
    out, ptr = symbols(both, np.array([0, 2, 2, 4, 6]))
    assert out.tobytes() == b"a   b" and ptr.tolist() == [0, 2, 2, 3, 5]


def test_gradients_by_differences():
    model = BiGRU(["x", "y"], hidden=3, kind=np.float64)
    x, label = np.array([[97, 100, 195], [98, 32, 169], [99, 32, 122]]), np.array([0, 1, 1])

    def loss():
        both = np.concatenate([model._taped(w, x)[0] for w in "fb"], axis=2)
        logs = language_id._log_softmax(both @ model.p["v"] + model.p["d"])
        live = x != 32
        return -(logs[:, np.arange(3), label] * live).sum() / live.sum()

    g = model.gradients(x, label)
    for name, place in (("xf", (98, 1)), ("xb", (97, 4)), ("uf", (1, 7)), ("ub", (2, 0)), ("cf", (3,)), ("v", (4, 1)), ("d", (0,))):
        old = model.p[name][place]
        model.p[name][place] = old + 1e-5
        up = loss()
        model.p[name][place] = old - 1e-5
        down = loss()
        model.p[name][place] = old
        assert abs((up - down) / 2e-5 - g[name][place]) < 1e-6


def sums_by_byte(model, x):
    """The network's sums over one text, unit by unit, in spans with their context."""
    out, n, h = np.zeros(len(model.labels)), 0, model.hidden
    for a in range(0, len(x), language_id.SPAN):
        b = min(a + language_id.SPAN, len(x))
        at = range(a - language_id.CONTEXT, a + -(-(b - a) // language_id.STEP) * language_id.STEP + language_id.CONTEXT)
        seen = [int(x[i]) if 0 <= i < len(x) else 32 for i in at]
        states = {}
        for way, order in (("f", range(len(seen))), ("b", range(len(seen) - 1, -1, -1))):
            state = np.zeros(h)
            wx, u, c = (model.p[k + way].astype(float) for k in "xuc")
            for t in order:
                z = 1 / (1 + np.exp(-(wx[seen[t], :h] + c[:h] + state @ u[:, :h])))
                r = 1 / (1 + np.exp(-(wx[seen[t], h : 2 * h] + c[h : 2 * h] + state @ u[:, h : 2 * h])))
                new = np.tanh(wx[seen[t], 2 * h :] + c[2 * h :] + (r * state) @ u[:, 2 * h :])
                state = (1 - z) * state + z * new
                states[way, t] = state
        for t, i in enumerate(at):
            if a <= i < b and seen[t] != 32:
                scores = np.r_[states["f", t], states["b", t]] @ model.p["v"] + model.p["d"]
                out += scores - np.log(np.exp(scores).sum())
                n += 1
    return out, n


def test_sums_against_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "SPAN", 40)
    monkeypatch.setattr(language_id, "STEP", 8)
    model = BiGRU(["x", "y", "z"])
    texts = [read(t) for t in ("", "a", "Hello  wörld " * 9, "123", "x" * 80, "ab cd " * 7 + "é")]
    sums, counts = model.sums(np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])])
    for t, s, n in zip(texts, sums, counts, strict=True):
        want, k = sums_by_byte(model, t)
        assert n == k and np.allclose(s, want, atol=1e-3)


def test_held_out_accuracy_and_edges(spark):
    rows = make(300)
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", None), (1003, "the thing", None), (None, "schön", "cc"), (1004, "thing" * 20000, "aa")]
    odd += [(1005, "“ ” …", None), (1006, "los los los", "bb"), (1006, "los los los", "bb")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS copy")
    got = identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([by[i].lang_pred == lang for i, _, lang in rows if by[i].held_out]) >= 0.98
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006)] == ["und", "und", "und", "aa", "aa", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got)


def test_sample_takes_repeated_rows_once(spark):
    rows = [(7, "one text of many", "aa")] * 500 + [(i, f"text number {i}", "aa" if i % 2 else "bb") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    got = sample(df, 100, 256).collect()
    assert 100 <= sum(r.lang == "aa" for r in got) <= 280 and 100 <= sum(r.lang == "bb" for r in got) <= 280
    assert len({r.copy for r in got}) == len(got)


def test_nothing_to_learn(spark):
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    one = identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert one[0].lang_pred == "und"
    assert train([("aa", [b" "])]) is None
