"""The build loop: from entries to all modules that they lead to, and the edges between them.

Each round takes the modules found in the last one through loading, extraction and resolving, all as tables: distinct
requests of a directory are resolved once, a path that is known already only gets an edge, and what can't be read or
found stays in the graph as an error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_keys, module_type
from ..sources.files import resolve
from ..sources.javascript import dependencies
from .fixpoint import rows, settle


class Graph(NamedTuple):
    """modules: (path, module_type, depth, error); edges: (origin, dep_index, dep_type, request, ids, name, in_block, module,
    state), origin null for entries, module null where nothing was found; missing: (directory, request)."""

    modules: DataFrame
    edges: DataFrame
    missing: DataFrame


_EDGE = ["origin", "dep_index", "dep_type", "request", "ids", "name", "in_block"]
#: Kinds of dependencies that name no module.
_LOCAL = ("export_specifier", "export_expression", "error")


def _resolved(asked: DataFrame, listing: DataFrame) -> DataFrame:
    """asked(directory, request, ...) with path: each distinct request of a directory is resolved once."""
    once = asked.select("directory", "request").distinct().withColumn("id", F.concat_ws("\n", "directory", "request"))
    found = resolve(once, listing).join(once, "id").select(F.col("directory").alias("d"), F.col("request").alias("r"), "path")
    return asked.join(found, (F.col("directory") == F.col("d")) & (F.col("request") == F.col("r")), "left").drop("d", "r")


def build(
    sources: DataFrame, entries: DataFrame, context: str = "", loader: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int = 10_000
) -> Graph:
    """sources: (path, source), entries: (entry_index, name, request), relative to context. loader: makes (path, source) of
    the modules of a round from theirs, before they are read."""
    listing = settle(sources.select("path").distinct())
    seeds = entries.select(
        F.lit(None).cast("string").alias("origin"), F.col("entry_index").alias("dep_index"), F.lit("entry").alias("dep_type"), "request",
        F.array().cast("array<string>").alias("ids"), "name", F.lit(False).alias("in_block"), F.lit(context).alias("directory"),
    )
    edges = [settle(_resolved(seeds, listing))]
    modules: list[DataFrame] = []
    for depth in range(max_rounds):
        found = edges[-1].where("path IS NOT NULL").select("path").distinct()
        for m in modules:
            found = found.join(m.select("path"), "path", "left_anti")
        here = found.join(sources.select("path", "source"), "path")
        here = loader(here) if loader else here
        kind = module_type(F.col("path"))
        read = settle(here.select("path", "source", kind.alias("module_type"), F.xxhash64("path").alias("module_id")))
        if not rows(read):
            break
        parsed = dependencies(read.where("module_type != 'json'").select("module_id", "source"))
        parsed = settle(parsed.join(read.select("module_id", F.col("path").alias("origin")), "module_id").drop("module_id"))
        broken = parsed.where("error IS NOT NULL").groupBy(F.col("origin").alias("path")).agg(F.min("error").alias("message"))
        error = F.when((F.col("module_type") == "json") & json_keys(F.col("source")).isNull() & F.try_parse_json("source").isNull(), "not valid JSON").otherwise(F.col("message"))
        modules.append(settle(read.join(broken, "path", "left").select("path", "module_type", F.lit(depth).alias("depth"), error.alias("error"))))
        asked = parsed.where(~F.col("dep_type").isin(*_LOCAL) & F.col("request").isNotNull())
        directory = F.regexp_replace("origin", "/?[^/]*$", "")
        edges.append(settle(_resolved(asked.select(*_EDGE, directory.alias("directory")), listing)))
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.unionByName(e)
    known = modules[0] if modules else listing.limit(0).select("path", F.lit("").alias("module_type"), F.lit(0).alias("depth"), F.lit("").alias("error"))
    for m in modules[1:]:
        known = known.unionByName(m)
    missing = whole.where("path IS NULL").select("directory", "request").distinct()
    return Graph(known, whole.select(*_EDGE, F.col("path").alias("module"), F.lit("active").alias("state")), missing)
