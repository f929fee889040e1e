"""Recursion over DataFrames: a loop that carries only what is new.

Spark's recursive CTE knows only UNION ALL, so cyclic graphs need a loop. Each round
joins the frontier alone, drops what is known already with an anti join, and writes the
delta to the folder that ``spark.checkpoint.dir`` names: lineage stays one round long and
a lost executor costs one task, not the loop.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only where all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs in here go when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a written table: evaluated once, no lineage. :func:`rows` tells how many rows were written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fix-{uuid.uuid4().hex}"
    seen = Observation()
    with _shuffles_dropped(spark):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path, out._loom_rows = path, seen.get["n"]
    return out


def rows(settled: DataFrame) -> int:
    return settled._loom_rows


def drop(*settled: DataFrame | None) -> None:
    """Delete settled tables that no later plan reads."""
    for df in settled:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loom_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, max_rounds: int = 1000) -> DataFrame:
    """The least set that holds ``seed`` and ``step`` of its own rows (set semantics on ``keys``).

    ``step`` gets the rows that are new since the last round; other columns than the keys
    keep the values of the first round that found a row, so a depth is the shortest one.
    """
    keys = keys or seed.columns
    frontier = settle(seed.dropDuplicates(keys))
    parts = [frontier]
    for _ in range(max_rounds):
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        found = step(frontier).select(seed.columns).dropDuplicates(keys)
        frontier = settle(found.join(known.select(keys), keys, "left_anti"))
        if not rows(frontier):
            drop(frontier)
            known._loom_parts = parts
            return known
        parts.append(frontier)
        if len(parts) > 12:
            whole = settle(known.unionByName(frontier))
            drop(*parts[:-1])  # the frontier is read once more
            parts = [whole]
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(root, node, depth): nodes reachable from each root over edges (src, dst), with the fewest steps.

    seeds: (root, node), usually with root = node.
    """
    hops = settle(edges.select("src", "dst").distinct())  # read in every round, so computed once

    def step(new: DataFrame) -> DataFrame:
        here = new.join(hops, new["node"] == hops["src"])
        return here.select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))

    start = seeds.select("root", "node", F.lit(0).alias("depth"))
    found = fixpoint(start, step, ["root", "node"], max_rounds)
    drop(hops)
    return found


def reach_sets(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(root, node): what each root of roots(root) reaches over edges (src, dst), itself included; as :func:`reach`, without depths.

    64 roots share a row: the bits of ``mask`` tell which of a block's roots reach a node, so what many roots reach
    in common takes a 64th of the pairs. Roots are numbered in their order, as neighbours often reach the same.
    The pairs are made where the result is read, they are never written.
    """
    hops = settle(edges.select("src", "dst").distinct())
    # sorted partitions count in ranges of 2^33, so no block holds roots of two
    numbered = settle(roots.select("root").distinct().orderBy("root").withColumn("n", F.monotonically_increasing_id()))
    named = numbered.select("root", F.shiftrightunsigned("n", 6).alias("block"), F.expr("shiftleft(1L, CAST(n & 63 AS INT))").alias("bit"))
    known = settle(named.groupBy("block", F.col("root").alias("node")).agg(F.bit_or("bit").alias("mask")).withColumn("new", F.col("mask")))
    for _ in range(max_rounds):
        fresh = known.where("new <> 0")
        if fresh.isEmpty():
            break
        ahead = fresh.join(hops, fresh["node"] == hops["src"]).groupBy("block", F.col("dst").alias("node")).agg(F.bit_or("new").alias("new"))
        both = known.select("block", "node", "mask", F.lit(0).cast("long").alias("new")).unionByName(ahead.withColumn("mask", F.lit(0).cast("long")))
        both = both.groupBy("block", "node").agg(F.bit_or("mask").alias("mask"), F.bit_or("new").alias("new"))
        after = settle(both.select("block", "node", F.expr("mask | new").alias("mask"), F.expr("new & ~mask").alias("new")))
        drop(known)
        known = after
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    drop(hops)
    return known.select("block", "node", "mask").join(named, "block").where("mask & bit <> 0").select("root", "node")
