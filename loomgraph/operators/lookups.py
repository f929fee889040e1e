"""Questions to a graph: edges of a module, groupings, issuers, identifiers, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outgoing(connections: DataFrame, modules: DataFrame) -> DataFrame:
    """The active and inactive edges that start at modules(module), with their state."""
    return connections.join(modules.select(F.col("module").alias("origin")), "origin", "left_semi")


def incoming(connections: DataFrame, modules: DataFrame) -> DataFrame:
    return connections.join(modules.select("module"), "module", "left_semi")


def by_position(connections: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges by (origin, block_index, dep_index); a null block is the top level."""
    a, c = asked.alias("a"), connections.alias("c")
    return c.join(a, F.expr("c.origin = a.origin AND c.block_index <=> a.block_index AND c.dep_index = a.dep_index"), "left_semi")


def group_incoming(connections: DataFrame) -> DataFrame:
    """(module, origin, n): edges by target and origin; no origin is a group of its own."""
    return connections.groupBy("module", "origin").agg(F.count("*").alias("n"))


def group_outgoing(connections: DataFrame) -> DataFrame:
    return connections.groupBy("origin", "module").agg(F.count("*").alias("n"))


def issuer(modules: DataFrame, connections: DataFrame) -> DataFrame:
    """(module, has_incoming, issuer): the origin of the first edge that has one."""
    first = connections.groupBy("module").agg(
        F.lit(True).alias("has_incoming"), F.min_by("origin", F.when(F.col("origin").isNotNull(), F.col("conn_id"))).alias("issuer")
    )
    return modules.select("module").join(first, "module", "left").select("module", F.coalesce("has_incoming", F.lit(False)).alias("has_incoming"), "issuer")


def targets(connections: DataFrame) -> DataFrame:
    """(conn_id, resolved_module, module): where an edge was resolved to and where it leads now."""
    return connections.select("conn_id", "resolved_module", "module")


def edge_dedup(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first sighting by order of each identity."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def request_groups(dependencies: DataFrame) -> DataFrame:
    """(origin, request, n, first): each distinct request of a module once."""
    return dependencies.groupBy("origin", "request").agg(F.count("*").alias("n"), F.min("conn_id").alias("first"))


def module_chunks(members: DataFrame) -> DataFrame:
    """(module, n, chunks): chunks in order, joined by a comma."""
    joined = F.concat_ws(",", F.array_sort(F.collect_set("chunk")))
    return members.groupBy("module").agg(F.count_distinct("chunk").alias("n"), joined.alias("chunks"))


def references(modules: DataFrame, ids: DataFrame, connections: DataFrame, members: DataFrame) -> DataFrame:
    """(module, id, chunks, targets): what a module's code refers to: own id, chunks, targets' ids in edge order."""
    named = connections.where("origin IS NOT NULL").join(ids.select("module", F.col("id").alias("target")), "module")
    to = named.groupBy(F.col("origin").alias("module")).agg(F.array_sort(F.collect_list(F.struct("conn_id", "target"))).alias("t"))
    to = to.select("module", F.concat_ws(",", F.transform("t", lambda x: x["target"])).alias("targets"))
    return modules.select("module").join(ids, "module", "left").join(module_chunks(members).select("module", "chunks"), "module", "left").join(to, "module", "left")


def chunk_modules(members: DataFrame) -> DataFrame:
    """(chunk, n, modules): a chunk's modules in order, joined by a comma."""
    joined = F.concat_ws(",", F.array_sort(F.collect_set(F.col("module").cast("string"))))
    return members.groupBy("chunk").agg(F.count_distinct("module").alias("n"), joined.alias("modules"))


def ordered_modules(members: DataFrame, facts: DataFrame, order: list) -> DataFrame:
    """(chunk, module, place): each chunk's modules, from 0, by sort keys over facts(module, ...); the module breaks ties."""
    place = Window.partitionBy("chunk").orderBy(*order, "module")
    return members.select("chunk", "module").distinct().join(facts, "module").select("chunk", "module", (F.row_number().over(place) - 1).alias("place"))


def entry_modules(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(chunk, module) of members that are entries(module)."""
    return members.select("chunk", "module").distinct().join(entries.select("module"), "module", "left_semi").select("chunk", "module")


def module_id(modules: DataFrame, ids: DataFrame) -> DataFrame:
    """(module, id) of modules(module); null where a module has none."""
    return modules.select("module").join(ids.select("module", "id"), "module", "left")


def same_paths(one: DataFrame, two: DataFrame) -> DataFrame:
    """(owner, same): whether both tables of (owner, path) hold the same paths of an owner."""
    both = one.select("owner", "path", F.lit(1).alias("side")).union(two.select("owner", "path", F.lit(2).alias("side")))
    sides = both.groupBy("owner", "path").agg(F.count_distinct("side").alias("n"))
    return sides.groupBy("owner").agg((F.min("n") == 2).alias("same"))
