import random

from loomgraph.llm.minhash_neardup import near_duplicates


def shingles(text):
    w = [bytes(x).lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(x), find(y)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows if i is not None)


def edited(r, words, n, vocab):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(vocab)
    return " ".join(words)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").drop("n")
    return [tuple(x) for x in near_duplicates(df, **more).collect()]


def test_groups_of_near_copies_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    for size, edits in ((150, 9), (40, 6), (5, 3), (3, 2), (2, 1)):
        base = [r.choice(vocab) for _ in range(150)]
        for _ in range(size):
            rows.append((i, edited(r, base, r.randint(0, edits), vocab)))
            i += 1
    for _ in range(60):
        rows.append((i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))))
        i += 1
    texts = [t for _, t in rows]
    r.shuffle(texts)
    rows = [(n, t) for n, t in enumerate(texts)]
    got = sorted(run(spark, [(*x, 0) for x in rows], block=16))
    assert got == brute(rows)


def test_edges(spark):
    long = " ".join(f"u{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Short One"), (5, "short one"), (6, long), (7, long.upper() + " x"), (9, "a b c d e f")]
    got = sorted(run(spark, [(*x, 0) for x in rows]))
    assert got == brute(rows)
    assert got[3][2] == 4 and got[4][2] == 4 and got[6][2] == 6
    assert run(spark, []) == []
    repeated = run(spark, [(4, "a b c d e f", 0), (4, "a b c d e f", 0), (None, "a b c d e f", 0)])
    assert sorted(repeated, key=str) == [(4, 2, 4, True), (4, 2, 4, True), (None, 2, None, True)]
