import math
import random
import re

from pyspark.sql import functions as F

from loomgraph.llm import url_filter
from loomgraph.llm.url_filter import RULES, Model, judge


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(url):
    host, path = split(url)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


ODD = [
    None, "", "://", "http://", "http://ORG", "http://Org/", "http://a.org/x?y#z", "http://example.org/es/1", "http://x.example.org/en/12", "http://example.org/en/2",
    "http://xexample.org/es/", "http://a.com/fr/", "http://a.com/de/x", "http://a.com#/de/", "http://a.com?u=/de/", "a.com/de/", "ftp://É.com/de/é", "http://a://b.org/",
    "http://a.net/" + "x" * 5000,
]


def test_rules_and_parts(spark):
    rows = list(enumerate(ODD)) + [(None, "http://a.org/"), (3, "http://"), (3, "http://")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS depth")
    got = judge(df).collect()
    want = sorted(((i, *split(u), *rule(u)) for i, u in rows), key=str)
    assert [x[:4] for x in sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str)] == [x[:4] for x in want]
    assert all(r.verdict == dict((h + p, v) for h, p, v in RULES)[r.rule] for r in got if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got)
    assert judge(df.limit(0)).collect() == []


def test_trees_learn_from_rules_alone(spark):
    r = random.Random(4)
    rows = []
    for i in range(1500):
        bad = r.random() < 0.5
        name = "".join(r.choice("abcdefg") for _ in range(6)) + ("-cheap-pills" if bad else "")
        zone = r.choice(["net", "com", "org"])
        path = {"com": "/de/" if bad else "/fr/", "org": "/es/" if bad else "/a/", "net": "/q/"}[zone]
        host = "example.org" if zone == "org" else f"{name}.{zone}"
        rows.append((i, f"http://{name}.{host}{path}{i}" if zone == "org" else f"http://{host}{path}{i}", bad))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    plan = judge(df)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)
    free = df.join(plan, "page_id").where("rule IS NULL")
    right = free.agg(F.avg(((F.col("verdict") == "block") == F.col("bad")).cast("int"))).first()[0]
    assert right > 0.9


def value(tree, row, at=1):
    while at in tree.splits:
        name, limit = tree.splits[at]
        at = 2 * at + (row[name] > limit)
    return tree.leaves.get(at, 0.0)


def test_trees_against_brute_force(spark, monkeypatch):
    """Suffix rates, splits and scores, computed again row by row in Python."""
    r = random.Random(6)
    rows = [(f"http://{r.choice('abc')}{r.choice(['', '-x'])}.{r.choice(['de', 'fr'])}/{r.choice(['p', 'q/r', 's?a=1&b=2', '9'])}{r.randrange(200)}",) for _ in range(400)]
    urls = url_filter.parts(spark.createDataFrame(rows, "url string"))
    labelled = urls.withColumn("y", (F.col("host").endswith("de") & F.col("path").rlike("[1-6]$") | F.col("host").contains("-")).cast("int"))
    kept = {}
    monkeypatch.setattr(url_filter, "fit", lambda full, trees: kept.update(full=[x.asDict() for x in full.collect()], model=fit(full, trees)) or kept["model"])
    fit = FIT
    model = Model(labelled, trees=3)
    full, (start, trees) = kept["full"], kept["model"]
    assert len({x["url"] for x in full}) == len(full) == len({u for u, in rows})
    prior = sum(x["y"] for x in full) / len(full)

    def rate(some):
        return (sum(x["y"] for x in some) + 5 * prior) / (len(some) + 5)

    for x in full:
        for name, k in (("suffix_1", 1), ("suffix_2", 2)):
            end = ".".join(x["host"].split(".")[-k:])
            same = [y for y in full if ".".join(y["host"].split(".")[-k:]) == end]
            assert abs(x[name] - rate([y for y in same if y["fold"] != x["fold"]])) < 1e-12
    # the first split is the best one of all thresholds
    p = 1 / (1 + math.exp(-start))

    def gain(name, limit):
        parts = [[x for x in full if (x[name] <= limit) == side] for side in (True, False)]
        g, h = ([sum(f(x) for x in part) for part in parts] for f in (lambda x: x["y"] - p, lambda x: p * (1 - p)))
        return g[0] ** 2 / (h[0] + 1) + g[1] ** 2 / (h[1] + 1) - sum(g) ** 2 / (sum(h) + 1) if all(parts) else 0

    name, limit = trees[0].splits[1]
    assert gain(name, limit) >= max(gain(f, x[f]) for f in url_filter.FEATURES for x in full[::7]) * 0.98
    got = {x.url: x for x in model.score(urls).collect()}
    for x in full:
        mine = dict(x)
        for name, k in (("suffix_1", 1), ("suffix_2", 2)):
            end = ".".join(x["host"].split(".")[-k:])
            mine[name] = rate([y for y in full if ".".join(y["host"].split(".")[-k:]) == end])
        want = 1 / (1 + math.exp(-(start + sum(value(t, mine) for t in trees))))
        assert abs(got[x["url"]].score - want) < 1e-9


FIT = url_filter.fit
