import random

import corpus_pipeline
from tests.llm.test_minhash_neardup import brute as brute_groups
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_substring_dedup import brute as brute_spans

VOCAB = {"aa": [f"th{a}ing{b}" for a in "abcdef" for b in "klmnop"], "bb": [f"ción{a}ñ{b}" for a in "abcdef" for b in "klmnop"]}


def make():
    r = random.Random(8)
    rows = []
    passage = " ".join(r.choice(VOCAB["aa"]) for _ in range(55))
    for i in range(90):
        lang = "aa" if i % 3 else "bb"
        words = [r.choice(VOCAB[lang]) for _ in range(r.randint(25, 160))]
        rows.append([i, " ".join(words), lang, f"src{i % 2}"])
    for i in (10, 20, 31):
        rows[i][1] += "\n" + passage
    for i in range(90, 100):
        rows.append([i, rows[i - 60][1].replace(" ", "  ", 3), rows[i - 60][2], "src0"])
    rows += [[100, "123 456", None, "src1"], [101, None, "aa", "src1"], [102, "", None, None], [103, "word " * 90, "aa", "src1"]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def test_stages_against_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = make()
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(map(tuple, docs.collect()))
    assert [r[0] for r in kept["language"]] == [r[0] for r in rows if r[0] not in (100, 101, 102)]
    good = {x[0] for x in brute_quality([(r[0], r[1], r[3]) for r in kept["language"]], 100, 30) if x[-1]}
    assert [r[0] for r in kept["quality"]] == sorted(good) and 103 not in good
    first = {x[0] for x in brute_groups([r[:2] for r in kept["quality"]]) if x[3]}
    assert [r[0] for r in kept["near_duplicate"]] == sorted(first) and not first & set(range(90, 100))
    spans = {i: (gone, left) for i, _, gone, left in brute_spans([r[:2] for r in kept["near_duplicate"]])}
    assert any(gone for gone, _ in spans.values())
    want = [(i, spans[i][1] if spans[i][0] else t) for i, t, *_ in kept["near_duplicate"] if spans[i][1]]
    assert [r[:2] for r in kept["substring"]] == want and all(r[4] == len(r[1]) for r in kept["substring"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in kept["substring"]}
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) == -(-total // 2048)


def test_common_lines_go_from_small_hosts(spark, tmp_path):
    texts = [" ".join(f"w{i}x{j}" for j in range(25)) for i in range(40)]
    line = "all rights reserved by the owners of this page"
    rows = [(i, f"{t}\n{line}" if i < 5 else t, "aa", "src0", len(t) + (i < 5) * (len(line) + 1)) for i, t in enumerate(texts)]
    rows += [(50, f"only here\n{line}\n{line}\n{line}", "aa", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()))
    want = [rows[0]] + [(i, t, "aa", "src0", len(t)) for i, t in enumerate(texts) if i]
    assert got == want


def test_odd_rows_and_columns(spark, tmp_path):
    """Null and repeated ids, and columns that are named like those inside: each stage keeps what it should."""
    r = random.Random(9)
    text = lambda: " ".join(r.choice(VOCAB["aa"]) for _ in range(60))
    texts = [text() for _ in range(30)]
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "aa", "s", 0), (None, text(), None, None, 0), (None, None, "aa", "s", 0), (40, text(), "aa", "s", 0), (40, text(), "aa", "s", 0)]
    rows += [(41, texts[4], "aa", None, 0), (50, "x y", "aa", "s", 0)] + [(42, t, "aa", "s", 0) for t in [text()] * 3]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*x, 1, "k", 2.0, "t", 5) for x in rows], names + ", key long, row string, v_key double, kept_text string, n_line_words int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == docs.where("key = 1 AND row = 'k' AND v_key = 2.0 AND kept_text = 't' AND n_line_words = 5").count()
        seen[name] = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted(seen["language"], key=str) == sorted(((i, t) for i, t, *_ in rows if t), key=str)
    assert sorted(seen["quality"], key=str) == sorted(((i, t) for i, t, *_ in rows if t and i != 50), key=str)
    want = [(i, t) for i, t, *_ in rows[:30]] + [rows[31][:2], rows[33][:2], rows[34][:2], rows[-1][:2]]
    assert sorted(seen["near_duplicate"], key=str) == sorted(want, key=str)
    assert sorted(seen["substring"], key=str) == sorted(want, key=str)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
