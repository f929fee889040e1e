"""Verdicts on URLs: rules first, then gradient-boosted trees on lexical features.

Rules are (host suffix, path prefix, verdict); the one with the longest text that fits
wins. URLs that a rule settles are labelled by it, and about ``sample`` distinct ones of them train the
trees: least-squares boosting of the logistic loss on histograms, one aggregation of
gradients by (node, feature, bin) for each level of a tree. The trees become one SQL
expression, so scoring is a projection inside whole-stage code: there is no Python,
Arrow or RDD anywhere, and nothing but the rules and a few numbers leaves the executors.

Features: lengths of URL, host and path, depth of path and host, share of digits,
character entropy, parameters, hyphens, scheme, and how often the host's last label and
last two labels were blocked in the training sample (smoothed). While trees are trained, a URL's own
fold of the sample is left out of these rates, so they tell as little of its label as an unseen one's.

Nulls: a null url, or one without ``://``, has an empty host and path, and no features;
it is judged by the trees like any other. With no labelled URLs of both kinds the more
frequent verdict (allow, if there is none) is everyone's. Ids may be null or repeated:
rows are independent. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, hash_sample, pick, written

Rule = tuple[str, str, str]

#: Fixed values of the contract: host, path, verdict.
RULES: list[Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """Adds host and path of column url."""
    rest = F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    out = urls.withColumn("rest", F.coalesce(rest, F.lit("")))
    plain = F.substring_index(F.substring_index("rest", "?", 1), "#", 1)
    raw_host = F.substring_index(plain, "/", 1)
    return (
        out.withColumn("host", F.translate(raw_host, UPPER, LOWER))
        .withColumn("path", F.expr("substring(substring_index(substring_index(rest, '?', 1), '#', 1), length(host) + 1)"))
        .drop("rest")
    )


def rule_columns(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and rule_verdict: of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return urls.withColumn("rule", name).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    kinds = F.array_distinct(chars)
    share = F.transform(kinds, lambda k: F.size(F.filter(chars, lambda c: c == k)) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def _last_labels(n: int) -> Column:
    return F.substring_index("host", ".", -n)


LEXICAL = ["url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "secure"]
SUFFIXES = {"suffix_1": 1, "suffix_2": 2}
FEATURES = [*LEXICAL, *SUFFIXES]


def lexical(urls: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    values = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")),
        "labels": F.size(F.filter(F.split("host", "[.]"), lambda p: p != "")),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url),
        "parameters": F.when(F.locate("?", url) > 0, F.size(F.split(url, "[?&]")) - 1).otherwise(0),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "secure": F.startswith(url, F.lit("https://")).cast("int"),
    }
    return urls.withColumns({k: v.cast("double") for k, v in values.items()})


def _smoothed(blocked: Column, n: Column, prior: float) -> Column:
    return (blocked + 5 * prior) / (n + 5)


def with_suffix_rates(sample: DataFrame, prior: float) -> tuple[DataFrame, dict[str, DataFrame]]:
    """sample with the rates of its hosts' suffixes, each row's from the other folds' rows alone; and the rates
    by suffix of all rows, which unseen URLs get."""
    rates = {}
    for name, labels in SUFFIXES.items():
        sample = sample.withColumn(f"of_{name}", _last_labels(labels))
        by_fold = sample.groupBy(F.col(f"of_{name}").alias("suffix"), "fold").agg(F.count("*").alias("n"), F.sum("y").alias("blocked"))
        whole = by_fold.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
        others = by_fold.join(whole, "suffix").select(
            F.col("suffix").alias(f"of_{name}"), "fold", _smoothed(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n"), prior).alias(name)
        )
        sample = sample.join(F.broadcast(others), [f"of_{name}", "fold"])  # no more rows than the sample
        rates[name] = whole.select(F.col("suffix").alias(f"of_{name}"), _smoothed(F.col("all_blocked"), F.col("all_n"), prior).alias(name))
    return sample, rates


def _rated(urls: DataFrame, rates: dict[str, DataFrame], prior: float) -> DataFrame:
    for name, labels in SUFFIXES.items():
        if name in rates:
            urls = urls.withColumn(f"of_{name}", _last_labels(labels)).join(F.broadcast(rates[name]), f"of_{name}", "left")  # no more rows than the sample
            urls = urls.withColumn(name, F.coalesce(name, F.lit(prior)))
        else:
            urls = urls.withColumn(name, F.lit(prior))
    return urls


class Tree:
    """Splits by node: (feature, threshold), children 2n and 2n + 1; leaves' values."""

    def __init__(self):
        self.splits: dict[int, tuple[str, float]] = {}
        self.leaves: dict[int, float] = {}

    def node(self, at: int = 1) -> Column:
        """The leaf that a row comes to."""
        if at not in self.splits:
            return F.lit(at)
        name, limit = self.splits[at]
        return F.when(F.col(name) <= limit, self.node(2 * at)).otherwise(self.node(2 * at + 1))

    def value(self, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(self.leaves.get(at, 0.0))
        name, limit = self.splits[at]
        return F.when(F.col(name) <= limit, self.value(2 * at)).otherwise(self.value(2 * at + 1))


def _bins(sample: DataFrame, most: int) -> dict[str, list[float]]:
    at = [i / most for i in range(1, most)]
    row = sample.agg(*(F.percentile_approx(f, at, 10000).alias(f) for f in FEATURES)).first()
    return {f: sorted(set(row[f])) for f in FEATURES}


def _bin(name: str, limits: list[float]) -> Column:
    """The first limit that the value doesn't exceed, by its place; as many as there are beyond the last."""
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col(name)))


def fit(sample: DataFrame, trees: int = 16, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """sample: FEATURES and y (1 blocked). One aggregation for each level of each tree."""
    limits = _bins(sample, bins)
    counted = sample.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    start = math.log((counted["y"] + 0.5) / (counted["n"] - counted["y"] + 0.5))
    # equal rows of bins are one from here on
    binned = sample.select("y", *(_bin(f, limits[f]).alias(f"b_{f}") for f in FEATURES), *FEATURES)
    binned = written(
        binned.groupBy("y", *(f"b_{f}" for f in FEATURES)).agg(F.count("*").alias("n"), *(F.min(f).alias(f) for f in FEATURES)), "binned"
    )
    grown: list[Tree] = []
    for _ in range(trees):
        tree = Tree()
        score = reduce(lambda a, t: a + t.value(), grown, F.lit(start))
        p = 1 / (1 + F.exp(-score))
        here = binned.withColumn("g", F.col("n") * (F.col("y") - p)).withColumn("h", F.col("n") * p * (1 - p))
        for level in range(depth):
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"b_{f}").alias("b")) for i, f in enumerate(FEATURES))))
            sums = (
                here.select(tree.node().alias("node"), "g", "h", cells.alias("cell"))
                .groupBy("node", "cell")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()  # nodes of a level x features x bins
            )
            table: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in sums:
                table.setdefault(r["node"], {}).setdefault(r["cell"]["f"], {})[r["cell"]["b"]] = (r["g"], r["h"])
            for node, by_feature in table.items():
                if node >> level != 1:
                    continue
                g, h = (sum(v[i] for v in by_feature[0].values()) for i in (0, 1))
                tree.leaves[node] = rate * g / (h + ridge)
                if found := _best_split(by_feature, limits, g, h, ridge):
                    tree.splits[node], (left_g, left_h) = found
                    # children that are never split themselves need no sums of their own
                    tree.leaves[2 * node] = rate * left_g / (left_h + ridge)
                    tree.leaves[2 * node + 1] = rate * (g - left_g) / (h - left_h + ridge)
            if not any(node >> level == 1 for node in tree.splits):
                break
        grown.append(tree)
    discard(binned)
    return start, grown


def _best_split(by_feature, limits, g: float, h: float, ridge: float) -> tuple[tuple[str, float], tuple[float, float]] | None:
    """(feature, threshold) and the sums of what goes left; of equal gains the first feature's lowest threshold."""
    best, split = 1e-6, None
    for f, name in enumerate(FEATURES):
        left_g = left_h = 0.0
        for b in sorted(by_feature.get(f, {})):
            left_g += by_feature[f][b][0]
            left_h += by_feature[f][b][1]
            if b >= len(limits[name]):
                break
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            if min(left_h, h - left_h) > 1e-6 and gain > best:
                best, split = gain, ((name, limits[name][b]), (left_g, left_h))
    return split


class Model:
    """Trees over lexical features and suffix rates; without both verdicts among its labels the more frequent one."""

    def __init__(self, labelled: DataFrame, sample: int = 20000, folds: int = 4, trees: int = 16):
        """labelled: url, host, path and y (1 blocked). About ``sample`` distinct URLs are learned from, those of the smallest hashes."""
        chosen = hash_sample(labelled.select("url", "host", "path", "y"), ["url"], sample).groupBy("url", "host", "path", "y").agg(F.count("*").alias("copies"))
        fold = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(folds)).cast("int")
        chosen = written(lexical(chosen.withColumn("fold", fold)), "labelled-urls")
        seen = chosen.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
        n, blocked = seen["n"], seen["y"] or 0
        self.prior = blocked / n if n else 0.0
        self.rates: dict[str, DataFrame] = {}
        self.chance = F.lit(1.0 if n and 2 * blocked > n else 0.0)
        if 0 < blocked < n:
            full, rates = with_suffix_rates(chosen, self.prior)
            self.rates = {k: written(v, "suffix-rates") for k, v in rates.items()}
            start, grown = fit(full, trees)
            self.chance = 1 / (1 + F.exp(-reduce(lambda a, t: a + t.value(), grown, F.lit(start))))

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds score, the chance of block, to urls with url, host and path."""
        return _rated(lexical(urls), self.rates, self.prior).withColumn("score", self.chance)


def judge(
    urls: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[Rule] = RULES,
    sample: int = 20000,
    threshold: float = 0.5,
) -> DataFrame:
    """Per row: page_id, host, path, rule (null where none fits), verdict and score (the trees' chance of block)."""
    rows = rule_columns(parts(pick(urls, page_id=id_col, url=url_col)), rules)
    labelled = rows.where("rule IS NOT NULL").withColumn("y", (F.col("rule_verdict") == "block").cast("int"))
    method = F.when(F.col("score") > threshold, "block").otherwise("allow")
    scored = Model(labelled, sample).score(rows)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score")
