import math

import numpy as np

from loomgraph.llm.embedding_neardup import traversal, vector_duplicates


def brute(rows, limit=0.93):
    def unit(v):
        if v is None or len(v) != 8 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    ok = [(i, lab, unit(v)) for i, v, lab in rows]
    links = {i: set() for i, _, _ in ok}
    for i, a, x in ok:
        for j, b, y in ok:
            if i != j and a is not None and a == b and x is not None and y is not None and x @ y >= limit:
                links[i].add(j)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(links[i]), min(seen), i == min(seen)))
    return sorted(out)


def make(seed):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        base = r.normal(size=8)
        for _ in range(int(r.integers(1, 12))):
            rows.append([list(map(float, base + r.normal(size=8) * r.uniform(0, 0.25))), c % 3])
        rows.append([list(map(float, base)), c % 3])
        rows.append([list(map(float, base)), c % 3])
    r.shuffle(rows)
    return [(i, v, int(lab)) for i, (v, lab) in enumerate(rows)]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "0 AS rep", "'x' AS cell")
    return sorted(map(tuple, vector_duplicates(df, **more).collect()))


def test_against_brute_force_and_recall(spark):
    rows = make(1)
    want = brute(rows)
    assert run(spark, rows, per_cell=4, block=5) == want
    found = sum(n for _, n, _, _ in run(spark, rows, per_cell=2, recall=0.95))
    assert found >= 0.9 * sum(n for _, n, _, _ in want)


def flat(n=600, width=64, dims=8):
    """Pairs right at the limit, in few of the dimensions."""
    r = np.random.default_rng(3)
    base = np.linalg.qr(r.normal(size=(width, dims)))[0].T
    x = r.normal(size=(n // 2, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = r.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    return np.r_[x, y] @ base


def test_few_dimensions(spark):
    x = flat()
    near = x @ x.T >= 0.93
    want = {i: int(n) - 1 for i, n in enumerate(near.sum(1))}
    assert sum(want.values()) >= len(x)
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    assert {i: n for i, n, _, _ in run(spark, rows, per_cell=4, block=20)} == want


def test_unusable_vectors(spark):
    one = [1.0] + [0.0] * 7
    bad = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [1.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate(bad)] + [(20, one, None), (21, one, 1), (22, [2.0] + [0.0] * 7, 1), (23, one, 2), (24, [-1e300] + [0.0] * 7, 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_multi_sequence_order():
    cells = list(traversal(np.array([0.0, 1.0, 5.0]), np.array([0.0, 2.0, 3.0])))
    assert len(cells) == 9 and [c for c, _, _ in cells] == sorted(c for c, _, _ in cells)
