import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import words
from loomgraph.llm.storage import hash_sample, row_key
from tests.llm.test_minhash_neardup import brute as brute_groups
from tests.llm.test_substring_dedup import brute as brute_spans


def periodic(n, flip):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b ^ flip] for b in bits[:n])


@pytest.mark.parametrize("n", [8, 16, 64, 65, 1024, 2048])
def test_periodic_words_differ(n):
    text = f"{periodic(n, 0)} {periodic(n, 1)} {periodic(n, 0)}"
    (s,) = words.slices(pa.array([text]))
    for h in s.spans(s.start, s.end):
        assert h[0] == h[2] != h[1]


def test_hashes_tell_words_and_runs_apart():
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 40))) for _ in range(300)]
    seen, of_run = {}, {}
    for s in words.slices(pa.array(texts), 1000):
        one, two = s.spans(s.start, s.end)
        for w, pair in zip(s.parts(s.start, s.end), zip(one.tolist(), two.tolist(), strict=True), strict=True):
            assert seen.setdefault(w, pair) == pair
        for k in (1, 2, 5, 8, 11, 20):
            first, h = s.grams(one, k)
            doc = np.searchsorted(s.ptr, first, side="right") - 1
            for f, d, x in zip(first.tolist(), doc.tolist(), h.tolist(), strict=True):
                here = texts[s.rows[0] + d].split(" ") if texts[s.rows[0] + d] else []
                at = f - s.ptr[d]
                run = tuple(here[at : at + k])
                assert len(run) == k and of_run.setdefault(run, x) == x
        ends = np.minimum(s.ptr[:-1] + 4, s.ptr[1:])
        short = words.short_runs(one, s.ptr[:-1], ends)
        for d, x in enumerate(short.tolist()):
            run = ("short", *texts[s.rows[0] + d].split()[:4])
            assert of_run.setdefault(run, x) == x
    assert len({x[0] for x in seen.values()}) == len({x[1] for x in seen.values()}) == len(seen)
    assert len(set(of_run.values())) == len(of_run)


def test_periodic_texts_in_the_operators(spark):
    from loomgraph.llm.minhash_neardup import near_duplicates
    from loomgraph.llm.substring_dedup import remove_repeats

    rows = [(i, " ".join([periodic(2048, i), *(f"t{j}" for j in range(25))][::-1])) for i in (0, 1)]
    rows += [(i, " ".join([periodic(2048, i % 2)] * 3)) for i in (2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in remove_repeats(df).collect()) == brute_spans(rows)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == brute_groups(rows)


def test_row_keys(spark):
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, "c"), (None, "a"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in df.select("*", row_key(df, "doc_id", "text").alias("key")).collect():
        got.setdefault(r.key, []).append((r.doc_id, r.text))
    assert sorted(map(len, got.values())) == [1, 1, 1, 1, 1, 2]
    assert got[1] == [(1, "a")] and got[3] == [(3, None)] and all(k >= 1 << 62 for k in got if k not in (1, 3))


def test_hash_sample(spark):
    df = spark.range(5000)
    n = hash_sample(df, ["id"], 1000).count()
    assert 800 < n < 1200 and hash_sample(df, ["id"], 5000).count() == 5000


def test_groups_by_bytes_whatever_the_hashes(monkeypatch):
    r = random.Random(2)
    text = " ".join(r.choice(["a", "B", "b", "x" * 70, "x" * 69 + "y", "é" * 5, "same" * 30]) for _ in range(500))
    (s,) = words.slices(pa.array([text]))
    for lower in (False, True):
        want = s.parts(s.start, s.end, lower)
        for collide in (False, True):
            if collide:
                monkeypatch.setattr(words, "span_hashes", lambda data, start, end: (np.zeros(len(start), np.uint64),) * 2)
            distinct, group = s.groups(s.start, s.end, lower)
            monkeypatch.undo()
            assert [distinct[g] for g in group] == want and len(set(distinct)) == len(distinct)
