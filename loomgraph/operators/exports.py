"""What modules provide and what of it is used, through re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import drop, fixpoint, settle

ALL = "*"


def provided_exports(modules: DataFrame, own: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, known, names): names sorted and joined by a comma, null where unknown.

    A module provides its own names and those of its named re-exports; with any star
    re-export its set is unknown. edges: (src, dst, kind, name, id).
    """
    named = edges.where("kind = 'reexp'").select(F.col("src").alias("module"), "name")
    names = own.select("module", "name").unionByName(named).groupBy("module").agg(F.array_sort(F.collect_set("name")).alias("names"))
    stars = edges.where("kind = 'star'").select(F.col("src").alias("module")).distinct().withColumn("star", F.lit(True))
    out = modules.select("module").join(names, "module", "left").join(stars, "module", "left")
    joined = F.concat_ws(",", F.coalesce("names", F.array().cast("array<string>")))
    return out.select("module", F.col("star").isNull().alias("known"), F.when(F.col("star").isNull(), joined).alias("names"))


def used_exports(provided: DataFrame, known: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(module, all_used, names) of modules of which something is used.

    provided: (module, name), known: (module) with a known set, entries: (module). Seeds:
    entries use all they provide (everything, if unknown), dynamic imports use everything,
    imports their id, whether or not their origin is alive. Named re-exports pass a used
    name on as their id; stars pass on everything, or each used name but default that the
    target may provide. Sets only grow, so any order of evaluation gives the same result.
    """
    edges = settle(edges.select("src", "dst", "kind", "name", "id"))
    ids = entries.select("module")
    seeds = (
        ids.join(known, "module", "left_anti").select("module", F.lit(ALL).alias("name"))
        .unionByName(ids.join(known, "module", "left_semi").join(provided, "module").select("module", "name"))
        .unionByName(edges.where("kind = 'dyn'").select(F.col("dst").alias("module"), F.lit(ALL).alias("name")))
        .unionByName(edges.where("kind = 'imp'").select(F.col("dst").alias("module"), F.col("id").alias("name")))
    )
    named = settle(edges.where("kind = 'reexp'").select("src", "dst", F.col("name").alias("given"), "id"))
    stars = settle(edges.where("kind = 'star'").select("src", "dst"))
    # read in every round, so computed once
    may = settle(provided.select(F.col("module").alias("dst"), "name").join(stars.select("dst").distinct(), "dst", "left_semi"))
    bounded = settle(known.select(F.col("module").alias("dst"), F.lit(True).alias("bounded")).join(stars.select("dst").distinct(), "dst", "left_semi"))

    def step(new: DataFrame) -> DataFrame:
        by_name = new.join(named, (new["module"] == named["src"]) & new["name"].isin(ALL) | (new["module"] == named["src"]) & (new["name"] == named["given"]))
        passed = new.join(stars, new["module"] == stars["src"]).select("dst", "name").join(bounded, "dst", "left")
        whole = passed.where(F.col("name") == ALL).select("dst", "name")
        free = passed.where((F.col("name") != ALL) & (F.col("name") != "default") & F.col("bounded").isNull()).select("dst", "name")
        held = passed.where((F.col("name") != ALL) & (F.col("name") != "default") & F.col("bounded").isNotNull()).select("dst", "name")
        held = held.join(may, ["dst", "name"], "left_semi")
        out = by_name.select("dst", F.col("id").alias("name")).unionByName(whole).unionByName(free).unionByName(held)
        return out.select(F.col("dst").alias("module"), "name")

    found = fixpoint(seeds, step)
    drop(edges, named, stars, may, bounded)
    used = found.groupBy("module").agg(
        F.bool_or(F.col("name") == ALL).alias("all_used"), F.concat_ws(",", F.array_sort(F.collect_set("name"))).alias("names")
    )
    return used.select("module", "all_used", F.when(~F.col("all_used"), F.col("names")).alias("names"))


def export_state(modules: DataFrame, provided: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """(module, name, provided): TRUE, FALSE, or NULL where the module's set is unknown. asked: (module, name)."""
    there = provided.select("module", "name").distinct().withColumn("there", F.lit(True))
    sure = known.select("module").withColumn("sure", F.lit(True))
    out = asked.join(modules.select("module"), "module", "left_semi").join(there, ["module", "name"], "left").join(sure, "module", "left")
    return out.select("module", "name", F.when(F.col("sure"), F.coalesce("there", F.lit(False))).alias("provided"))


def resolve_reexports(asked: DataFrame, edges: DataFrame, pure: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(module, name, final_module, final_name) for asked (module, name) that a chain of re-exports leads elsewhere.

    A pure module passes a name on by its only re-export of it, else (but default) by its
    only star. Chains that come back to a module they passed are dropped.
    """
    pure = pure.select(F.col("module").alias("at"))
    edges = settle(edges.where("kind IN ('reexp', 'star')").select("src", "dst", "kind", "name", "id"))
    named = edges.where("kind = 'reexp'").groupBy(F.col("src").alias("at"), F.col("name").alias("as_name")).agg(
        F.count("*").alias("n"), F.min("dst").alias("named_next"), F.min("id").alias("named_id"))
    named = settle(named.where("n = 1").drop("n").join(pure, "at", "left_semi"))
    stars = edges.where("kind = 'star'").groupBy(F.col("src").alias("at")).agg(F.count("*").alias("n"), F.min("dst").alias("star_next"))
    stars = settle(stars.where("n = 1").drop("n").join(pure, "at", "left_semi"))
    state = asked.select("module", "name").distinct().select(
        "module", "name", F.col("module").alias("at"), F.col("name").alias("as_name"), F.array("module").alias("seen"))
    done = []
    for _ in range(max_rounds):
        step = state.join(named, ["at", "as_name"], "left").join(stars, "at", "left")
        star = F.when(F.col("as_name") != "default", F.col("star_next"))
        step = step.withColumn("next", F.coalesce("named_next", star)).withColumn("next_name", F.when(F.col("named_next").isNotNull(), F.col("named_id")).otherwise(F.col("as_name")))
        step = settle(step)
        done.append(step.where("next IS NULL AND size(seen) > 1").select("module", "name", F.col("at").alias("final_module"), F.col("as_name").alias("final_name")))
        state = step.where("next IS NOT NULL AND NOT array_contains(seen, next)").select(
            "module", "name", F.col("next").alias("at"), F.col("next_name").alias("as_name"), F.array_append("seen", F.col("next")).alias("seen"))
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"re-exports not settled after {max_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def rewrite_edges(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """edges with module and id where their target leads on; resolved_module keeps the first target.

    Import edges move only where their origin asks one distinct name of the target; named
    re-exports always. All decisions are taken on the graph as it was.
    """
    single = edges.where("kind = 'imp'").groupBy("src", "dst").agg(F.count_distinct("id").alias("k")).where("k = 1").select("src", "dst", F.lit(True).alias("single"))
    to = resolved.select(F.col("module").alias("dst"), F.col("name").alias("id"), "final_module", "final_name")
    out = edges.join(single, ["src", "dst"], "left").join(to, ["dst", "id"], "left")
    moves = F.col("final_module").isNotNull() & ((F.col("kind") == "reexp") | (F.col("kind") == "imp") & F.coalesce("single", F.lit(False)))
    return out.select(
        "src", F.col("dst").alias("resolved_module"), F.when(moves, F.col("final_module")).otherwise(F.col("dst")).alias("module"),
        "kind", "name", F.when(moves, F.col("final_name")).otherwise(F.col("id")).alias("id"),
    )


def edge_activity(edges: DataFrame, used: DataFrame, pure: DataFrame) -> DataFrame:
    """edges with active. used: (module, all_used, names) of :func:`used_exports`.

    Side-effect imports (kind side) count if the target is impure or the origin also imports
    a name of it; re-exports if their name is used, stars if anything of the target is.
    """
    impure = pure.select(F.col("module").alias("dst"), F.lit(True).alias("pure"))
    imports = edges.where("kind = 'imp'").select("src", "dst").distinct().withColumn("imports", F.lit(True))
    of_src = used.select(F.col("module").alias("src"), F.col("all_used").alias("src_all"), F.split("names", ",").alias("src_names"))
    of_dst = used.select(F.col("module").alias("dst"), F.lit(True).alias("dst_used"))
    out = edges.join(impure, "dst", "left").join(imports, ["src", "dst"], "left").join(of_src, "src", "left").join(of_dst, "dst", "left")
    active = (
        F.when(F.col("kind") == "side", F.col("pure").isNull() | F.col("imports").isNotNull())
        .when(F.col("kind") == "reexp", F.coalesce(F.col("src_all") | F.array_contains("src_names", F.col("name")), F.lit(False)))
        .when(F.col("kind") == "star", F.col("dst_used").isNotNull())
        .otherwise(True)
    )
    return out.select("src", "dst", "kind", "name", "id", active.alias("active"))


def used_names(asked: DataFrame, used: DataFrame, analysed: bool = True) -> DataFrame:
    """(module, name, used_name): the name where it is used, null where not; without usage analysis all names are.

    asked: (module, name), used: (module, all_used, names) of :func:`used_exports`.
    """
    if not analysed:
        return asked.select("module", "name", F.col("name").alias("used_name"))
    out = asked.select("module", "name").join(used, "module", "left")
    there = F.coalesce(F.col("all_used") | F.array_contains(F.split("names", ","), F.col("name")), F.lit(False))
    return out.select("module", "name", F.when(there, F.col("name")).alias("used_name"))
