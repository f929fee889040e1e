import re
from collections import Counter, defaultdict

from loomgraph.llm.quality_rules import quality_rules, without_common_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + o for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for o in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def norm(line):
    return " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute(rows, limit, left):
    found, texts, first = defaultdict(set), defaultdict(set), {}
    for i, t, h in rows:
        for line in (t or "").split("\n"):
            if norm(line):
                found[h, norm(line)].add(t)
                texts[h].add(t)
                first[h, norm(line)] = min(first.get((h, norm(line)), i), i)
    out = []
    for i, t, h in rows:
        c = counts(t)
        gone = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if norm(x) and len(found[h, norm(x)]) > limit and 100 * len(found[h, norm(x)]) > 5 * len(texts[h]) and i != first[h, norm(x)])
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        depleted = c[0] > 0 and 100 * (c[0] - gone) < left * c[0]
        out.append((i, *c, gone, failed, depleted, not failed and not depleted))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    body = " ".join(f"w{i}" for i in range(25))
    rows = [(i, f"All Rights  reserved\n{body} {i}", "h1") for i in range(6)]
    rows += [(10 + i, f"all rights reserved\nAll rights reserved here and there\nx{i}", "h1") for i in range(4)] + [(15, "All rights reserved.", "h3")]
    rows += [(20, None, "h1"), (21, "", None), (22, " \n\t\n", "h2"), (23, "é ü # | <b>\né ü # | <b>\n", None)]
    rows += [(24, "a b c d e f g h " * 5, "h2"), (25, "é" * 100000 + " x" * 5000, "h2"), (26, body, "h3"), (26, body, "h3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_words", "'x' AS copy")
    got = sorted((tuple(r) for r in quality_rules(df, line_limit=3).collect()), key=str)
    assert got == brute(rows, 3, 30)


def test_null_id(spark):
    df = spark.createDataFrame([(None, "a b", "h")], "doc_id long, text string, source string")
    assert [tuple(r) for r in quality_rules(df).collect()] == [(None, 2, 2, 0, 0, 0, 0, True, False, False)]


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_common_lines_leave_the_texts(spark):
    body = " ".join(f"w{i}" for i in range(25))
    rows = [(i, f"All Rights  reserved\n{body} {i}\n\nall rights reserved", "h1", i) for i in range(6)]
    rows += [(8, body + " 8\n", "h1", 8), (9, f"all rights reserved\n{body}", None, 9), (10, "too short", "h1", 10)]
    rows += [(None, f"{body}\r\nall rights reserved\r\n{body[:9]} x", "h1", 11), (0, body + " another text", "h1", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = sorted(tuple(r) for r in without_common_lines(df, line_limit=3).select("n", "doc_id", "text", "n_line_words").collect())
    want = [(n, i, t, 0) for i, t, _, n in rows if n != 10]
    for i in range(1, 6):
        want[i] = (i, i, f"{body} {i}\n", 6)
    want[-2] = (11, None, f"{body}\r\n{body[:9]} x", 3)
    assert got == want
