import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm.packing import completion, completions, dominated, least_sequences, pack, plan
from loomgraph.llm.queries import op9_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, rows, size):
    tok = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS length", "'x' AS part")
    got = [r.asDict() for r in pack(df, PATH, size=size).collect()]
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), size)):
            part = ids[a : a + size]
            want.append((i, p, a, len(part), part.tobytes()))
    assert sorted(((*list(r.values())[:4], bytes(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(bins), sum(x[3] for x in want)


def test_places_and_ids(spark):
    r = random.Random(9)
    words = ["Hello", "world's", "naïve", "漢字", "é", "x1y2", "--", "ÀÉ", "<|endoftext|>", " z"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "word " * 500), (203, "x" * 3000), (None, "a b"), (7, "again"), (7, "again"), (8, "x<|endoftext|>Y.z <|EndOfText|>")]
    bins, total = check(spark, rows, 64)
    assert bins <= -(-total // 64) + 1
    check(spark, [], 64)
    check(spark, [(1, None)], 64)


def test_completion_beats_best_fit():
    counts = np.zeros(21, np.int64)
    counts[[9, 6, 4]] = [1, 1, 1]
    assert sorted(completion(counts, 10)) == [4, 6]
    assert completion(np.zeros(5, np.int64), 4) == []


def test_many_short_pieces():
    for counts in ({2: 5000, 3: 1}, {2: 1500, 5: 3}, {1: 100000, 2: 50000, 3: 7}):
        runs = plan(counts, 2048)
        assert sum(u * e for _, _, u, e, _, _ in runs) == sum(counts.values())
        assert max(s + u for _, _, u, _, s, _ in runs) == least_sequences(counts, 2048) == -(-sum(k * n for k, n in counts.items()) // 2048)


def optimum(items, size):
    """Fewest sequences, over all subsets of the items."""
    best = [(0, size)] + [(99, 0)] * ((1 << len(items)) - 1)
    for m in range(1, 1 << len(items)):
        for i, x in enumerate(items):
            if m >> i & 1:
                n, used = best[m ^ (1 << i)]
                best[m] = min(best[m], (n, used + x) if used + x <= size else (n + 1, x))
    return best[-1][0]


def test_plan_against_the_optimum():
    r = random.Random(3)
    more = 0
    for _ in range(200):
        size = r.randint(8, 40)
        items = [r.randint(1, size) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        runs, best = plan(counts, size), optimum(items, size)
        assert least_sequences(counts, size) <= best
        more += max(s + u for _, _, u, _, s, _ in runs) - best
    assert more <= 2


def test_query_derives_checksums(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    texts = {1: "Hello there", 2: None, 3: "word " * 3000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[:5] for r in op9_best_fit_packing(spark, str(tmp_path)).collect())
    want = []
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, a // 2048, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    assert got == want


def test_plan_is_near_the_bound():
    r = random.Random(1)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[r.randint(1, 2048)] += 1
    runs = plan(counts, 2048)
    assert sum(u * e for _, _, u, e, _, _ in runs) == 5000
    bins = max(s + u for _, _, u, _, s, _ in runs)
    assert bins <= 1.01 * max(sum(k * n for k, n in counts.items()) / 2048, sum(n for k, n in counts.items() if k > 1024))


def fillings(runs):
    """The lengths of each sequence."""
    out = defaultdict(list)
    for length, _, uses, each, sequence, _ in runs:
        for n in range(uses):
            out[sequence + n] += [length] * each
    return sorted(sorted(x) for x in out.values())


def test_plan_is_by_completion_where_best_fit_needs_as_few():
    assert fillings(plan({10: 1, 9: 1, 6: 1, 4: 1}, 20)) == [[4, 6, 10], [9]]


def test_plan_turns_back():
    r = random.Random(11)
    for _ in range(300):
        size = r.randint(8, 40)
        items = [r.randint(max(1, size // 6), size // 2) for _ in range(r.randint(6, 11))]
        got = fillings(plan({x: items.count(x) for x in items}, size))
        assert sorted(sum(got, [])) == sorted(items) and max(map(sum, got)) <= size
        assert len(got) == optimum(items, size)


def test_completions_by_rising_waste():
    r = random.Random(4)
    for _ in range(60):
        room = r.randint(1, 24)
        items = [r.randint(1, 12) for _ in range(r.randint(0, 7))]
        got = list(completions(np.bincount(items, minlength=room + 1), room))
        subsets = {tuple(sorted((x for i, x in enumerate(items) if m >> i & 1), reverse=True)) for m in range(1 << len(items))}
        assert [tuple(x) for x in got] == sorted((x for x in subsets if sum(x) <= room), key=lambda x: (sum(x), x), reverse=True)


def test_dominated():
    counts = np.bincount([6, 4, 3, 3], minlength=11)
    assert dominated([4, 3], counts, 10)  # 6 for 4 or 3, another 3 in the waste
    assert dominated([3, 3, 4], counts, 10)  # 6 for both 3
    assert not dominated([6, 4], counts, 10)
    assert not dominated([], np.zeros(11, np.int64), 10)
