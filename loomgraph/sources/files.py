"""Files and pages as modules: reading, routing, resolving, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, normalize_path


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, mtime, length, content, source, error): source is null and error set where bytes aren't UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    return raw.select(
        "path", F.col("modificationTime").alias("mtime"), "length", "content",
        F.when(F.is_valid_utf8(text), text).alias("source"),
        F.when(~F.is_valid_utf8(text), F.lit("not valid UTF-8")).alias("error"),
    )


def entries(spark: SparkSession, given: str | dict[str, str]) -> DataFrame:
    """(entry_index, name, request); a single request is the entry main."""
    named = {"main": given} if isinstance(given, str) else given
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(named.items())], "entry_index int, name string, request string")


def resolve(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """requests(id, directory, request) with path, query, fragment: the request itself, then with each extension, then its index."""
    bare = F.regexp_extract("request", r"^([^?#]*)", 1)
    base = normalize_path(F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat_ws("/", "directory", bare)))
    tails = ["", *EXTENSIONS, *("/index" + e for e in EXTENSIONS)]
    tried = requests.withColumn("base", base).withColumn(
        "try", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(t).alias("tail")) for i, t in enumerate(tails)))))
    tried = tried.withColumn("path", F.concat("base", "try.tail"))
    found = tried.join(listing.select("path"), "path").groupBy("id").agg(F.min_by("path", "try.rank").alias("path"))
    return requests.join(found, "id", "left").select(
        "id", "path",
        F.nullif(F.regexp_extract("request", r"(\?[^#]*)", 1), F.lit("")).alias("query"),
        F.nullif(F.regexp_extract("request", r"(#.*)$", 1), F.lit("")).alias("fragment"),
    )


def match_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, n_rules, module_type, error): one rule at most may fit; with more the path is an error."""
    fits = files.select("path").join(F.broadcast(rules), F.expr("path RLIKE test"), "left")  # rules are a configuration
    out = fits.groupBy("path").agg(F.count("test").alias("n_rules"), F.max("module_type").alias("t"))
    return out.select("path", "n_rules", F.when(F.col("n_rules") == 1, F.col("t")).alias("module_type"), (F.col("n_rules") > 1).alias("error"))


def side_effect_flag():
    """Rule over package over type default over parser; unknown means there are effects."""
    return F.coalesce("rule_free", "package_free", "type_free", "parser_free", F.lit(False))


def nearest_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, root, data): the package of the nearest directory above that has one, whatever it holds."""
    up = F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    above = files.select("path", F.explode(up).alias("root"))
    return above.join(packages, "root").groupBy("path").agg(F.max_by(F.struct("root", "data"), F.length("root")).alias("p")).select("path", "p.root", "p.data")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of each anchor of an html column, in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))
