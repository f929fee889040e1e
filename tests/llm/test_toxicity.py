import random

import numpy as np

from loomgraph.llm.toxicity import classify, fit_linear

WORDS = [f"w{i}" for i in range(300)]
CATEGORIES = {"junk": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}


def make(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 200))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["Vile!", "(awful)", "NASTY"])
        docs.append((i, " ".join(w)))
        labels.append((i, r.randint(0, 1), int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = make(1200, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS labels")
    known = spark.createDataFrame([x for x in labels if x[0] < 800], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(df, known, CATEGORIES).collect()}
    wrong = [i for i, _, t in labels if i >= 800 and got[i].toxic != bool(t)]
    assert len(got) == 1200 and len(wrong) <= 8
    assert all(0 <= r.p_junk <= 1 and 0 <= r.p_toxic <= 1 for r in got.values())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!! ?"), (4, "word " * 20000), (None, "x"), (5, "vile"), (5, "vile")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classify(df, none, CATEGORIES).collect()
    assert len(got) == 7 and not any(r.toxic for r in got)
    odd = spark.createDataFrame([(1, None, 1), (5, 1, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(classify(df, odd, CATEGORIES).collect()) == 7
    assert classify(df.limit(0), none, CATEGORIES).collect() == []


def test_linear_without_two_classes():
    m = fit_linear(np.array([1, 2]), np.array([0, 1, 2]), np.zeros((2, 0)), np.ones(2), 3)
    assert m.predict(np.array([1]), np.array([0, 1]), np.zeros((1, 0)))[0] > 0.99
