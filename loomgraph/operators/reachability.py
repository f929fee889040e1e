"""Closures over edge tables: reachability, transitive purity, affected sets, cycle tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import drop, fixpoint, reach, rows, settle


def static_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) for each root of roots(root); cycles end where a node is known."""
    return reach(edges, roots.select("root", F.col("root").alias("node")))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): nodes reachable from any seed(node), with the fewest steps."""
    start = seeds.select("node", F.lit(0).alias("depth"))
    hops = settle(edges.select("src", "dst").distinct())  # read in every round, so computed once

    def step(new: DataFrame) -> DataFrame:
        return new.join(hops, new["node"] == hops["src"]).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))

    found = fixpoint(start, step, ["node"])
    drop(hops)
    return found


def pure_modules(modules: DataFrame, side_effect_edges: DataFrame) -> DataFrame:
    """modules(module, self_pure): those that are pure themselves and import nothing impure, at any distance.

    A cycle of pure modules is pure: impurity spreads backwards from impure ones, the rest is pure.
    A null flag counts as impure.
    """
    impure = modules.where(~F.coalesce("self_pure", F.lit(False))).select(F.col("module").alias("node"))
    backwards = side_effect_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    spoiled = reachable(backwards, impure)
    return modules.select("module").join(spoiled, F.col("module") == F.col("node"), "left_anti")


def affected(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): modules whose signature changed, appeared or went, and all that import them.

    old, new: (module, signature).
    """
    a, b = old.alias("a"), new.alias("b")
    differs = a.join(b, "module", "full").where("NOT a.signature <=> b.signature")
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(backwards, differs.select(F.col("module").alias("node")))


def waits_in_cycle(waits: DataFrame) -> DataFrame:
    """(node): those that wait, directly or not, for themselves. waits: (src, dst), one dst at most for a src."""
    # every node has one way on, so each round halves what is left of it: the end of 2, 4, 8 ... steps from all nodes at once
    hop = settle(waits.select("src", "dst").distinct())
    far, steps, n = hop, 1, rows(hop)
    while steps < n:
        ahead = far.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
        after = settle(far.join(ahead, far["dst"] == ahead["mid"]).select("src", F.col("end").alias("dst")))
        if far is not hop:
            drop(far)
        far, steps = after, 2 * steps
        if not rows(far):
            break
    # after as many steps as there are nodes, one is on a cycle, and every node of the cycle is some node's end
    return far.select(F.col("dst").alias("node")).distinct()
