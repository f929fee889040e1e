"""Names that don't depend on the order of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv64
from ..plans.fixpoint import settle

#: Ranges that rows are numbered in, and keys that their bounds are chosen from.
RANGES, SAMPLED = 256, 16_384


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a column more: their place, from 0, in ascending order of keys, nulls first. Keys of structs, maps or null type aren't taken.

    A few bounds cut the order into ranges, which are sorted apart and begin where the counts
    of those before end. The bounds come from the keys of the smallest hashes, so they are the
    same however often rows are computed; rows with equal keys are in one range.
    """
    key = F.struct(*keys)
    types = [rows.schema[k].dataType for k in keys]
    sample = rows.select(*keys).distinct().orderBy(F.xxhash64(*keys), *keys).limit(SAMPLED)
    found = sample.orderBy(*keys).collect()
    bounds = [found[len(found) * i // RANGES] for i in range(1, RANGES)] if len(found) >= RANGES else found[1:]
    at = [F.struct(*(F.lit(v).cast(t).alias(k) for v, t, k in zip(b, types, keys, strict=True))) for b in bounds]
    within = F.size(F.filter(F.array(*at), lambda b: b <= key)) if at else F.lit(0)
    ranged = rows.withColumn("_range", within)
    # 256 rows at most
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    out = ranged.withColumn("_place", place).join(F.broadcast(begins), "_range")
    return out.select(*rows.columns, (F.col("_begin") + F.col("_place")).cast("long").alias(name))


def named_ids(items: DataFrame, reserved: list[str] | None = None) -> DataFrame:
    """(item, id, number) of items(item, short, full): a string id, or a number for those without a name.

    A short name that one item has, and that isn't reserved, is its id; others get the last
    six hex digits of a hash of the full name behind it, and the few whose result is taken
    a counter behind that. Unnamed items are numbered by full name.
    """
    taken = reserved or []
    alone = F.col("single").isNotNull() & ~F.col("short").isin(*taken)
    base = F.concat("short", F.lit("-"), fnv64("full").substr(11, 6))
    # counted before they are joined: one short name may have many of all items
    once = items.where("short != ''").groupBy("short").agg(F.count("*").alias("n")).where("n = 1").select(F.col("short").alias("single"))
    named = items.where("short != ''").join(once, F.col("short") == F.col("single"), "left").withColumn("base", F.when(alone, F.col("short")).otherwise(base))
    # a short name may look like another's base: the counter settles all that share one
    order = Window.partitionBy("base").orderBy(F.col("base") != F.col("short"), "short", "full", "item")
    again = F.row_number().over(order) - 1
    taken_base = F.col("base").isin(*taken) if taken else F.lit(False)
    suffix = F.when(taken_base, again).otherwise(again - 1)
    named = named.withColumn("suffix", suffix).select(
        "item", F.when(F.col("suffix") < 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("suffix").cast("string"))).alias("id")
    )
    numbers = [int(x) for x in taken if x.isdigit()]
    unnamed = numbered(items.where("short = ''").select("item", "full"), ["full", "item"], "number")
    for n in sorted(numbers):
        unnamed = unnamed.withColumn("number", F.when(F.col("number") >= n, F.col("number") + 1).otherwise(F.col("number")))
    none = F.lit(None)
    return named.select("item", "id", none.cast("long").alias("number")).unionByName(unnamed.select("item", none.cast("string").alias("id"), "number"))


def readable_names(modules: DataFrame, context: str) -> DataFrame:
    """modules(module, resource, query, fragment, layer, loaders) -> (module, name), relative to context."""

    def relative(path):
        return F.when(F.startswith(path, F.lit(context + "/")), F.substring(path, len(context) + 2, 1 << 20)).otherwise(path)

    resource = relative(F.col("resource"))
    shown = F.when(resource.rlike("^[./]"), resource).otherwise(F.concat(F.lit("./"), resource))
    loaders = F.array_join(F.transform(F.coalesce("loaders", F.array().cast("array<string>")), lambda x: F.concat(relative(x), F.lit("!"))), "")
    tails = [
        F.when(F.col("query").isNotNull(), F.concat(F.lit("?"), F.regexp_replace("query", "^[?]+", ""))),
        F.when(F.col("fragment").isNotNull(), F.concat(F.lit("#"), F.regexp_replace("fragment", "^#+", ""))),
        F.when(F.col("layer").isNotNull(), F.concat(F.lit("|layer:"), F.col("layer"))),
    ]
    name = F.concat(loaders, shown, *(F.coalesce(t, F.lit("")) for t in tails))
    return modules.select("module", F.when(resource == "", "").otherwise(name).alias("name"))


def module_identifier():
    """type|loader!...!resource?query#fragment, of identity columns."""
    tail = F.concat("resource", F.coalesce("query", F.lit("")), F.coalesce("fragment", F.lit("")))
    loaders = F.when(F.size("loaders") > 0, F.concat(F.array_join("loaders", "!"), F.lit("!"))).otherwise("")
    return F.concat("module_type", F.lit("|"), F.coalesce(loaders, F.lit("")), tail)


def identity_order() -> list:
    """Sort keys: type, path by components (not as a string), then query, fragment, layer and loaders, absent first."""
    return [F.col("type_ord"), F.split("resource", "/"), *(F.col(c).asc_nulls_first() for c in ("query", "fragment", "layer")), F.col("loaders").asc_nulls_first()]


def async_chunk_names(roots: DataFrame) -> DataFrame:
    """(chunk, short, full) of roots(chunk, name, key): names in order, other characters than letters and digits as underscores."""
    listed = roots.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("name", "key"))).alias("r"))
    ids = F.filter(F.transform("r", lambda x: F.regexp_replace(F.regexp_replace(x["name"], "^(\\./)+", ""), "[^A-Za-z0-9]", "_")), lambda x: x != "")
    full = F.concat(F.lit("async:"), F.array_join(F.transform("r", lambda x: x["key"]), "|"))
    return listed.select("chunk", F.array_join(ids, "-").alias("short"), full.alias("full"))


def chunk_ids(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(chunk, id, number) of all chunks: entries(chunk, name) first, then those of roots(chunk, name, key), which can't have an id of the former.

    Entries come from configuration, so what they are called is sent to the driver.
    """
    first = settle(named_ids(entries.select(F.col("chunk").alias("item"), F.col("name").alias("short"), F.concat(F.lit("entry:"), "name").alias("full"))))
    reserved = [r.id if r.id is not None else str(r.number) for r in first.select("id", "number").collect()]
    rest = named_ids(async_chunk_names(roots).select(F.col("chunk").alias("item"), "short", "full"), reserved)
    return first.unionByName(rest).withColumnRenamed("item", "chunk")


def output_filename():
    """Override, else name, else id, with .js behind the last two."""
    return F.coalesce("filename", F.concat("name", F.lit(".js")), F.concat(F.coalesce(F.col("id"), F.col("number").cast("string")), F.lit(".js")))
