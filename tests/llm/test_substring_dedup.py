import random
import re

from loomgraph.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        key = 2**63 - 1 if i is None else i
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, (key, p)), (key, p))
    out = []
    for i, w in words:
        key = 2**63 - 1 if i is None else i
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (key, p):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def check(spark, rows, window=20):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in remove_repeats(df, window=window).collect()]
    assert sorted(got, key=str) == brute(rows, window)


def test_random_copies_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    parts = [[r.choice(vocab) for _ in range(r.randint(15, 90))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.5:
                p = list(r.choice(parts))
                a = r.randint(0, len(p) // 2)
                p = p[a : r.randint(a, len(p))]
                if r.random() < 0.3 and p:
                    p[r.randrange(len(p))] = "edit"
                w += p
            else:
                w += [r.choice(vocab) for _ in range(r.randint(0, 40))]
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(w)))
    r.shuffle(rows)
    check(spark, rows)


def test_periodic_and_low_entropy_texts(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 200)))) for i in range(20)]
    rows += [(100, "x " * 300), (101, "x y " * 100), (102, "y x " * 90)]
    check(spark, rows)
    check(spark, rows, window=7)


def test_edges(spark):
    long = " ".join(f"u{i}" for i in range(50000))
    rows = [(1, None), (2, ""), (3, "   "), (4, long), (5, long + " tail"), (None, "n " * 40), (7, "é" * 3)]
    rows += [(8, " ".join(map(str, range(30))))] * 2
    check(spark, rows)
    check(spark, [])
