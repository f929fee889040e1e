"""What changed and what may be kept: snapshots, caches, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import drop, settle

DAY_S = 86400
#: Fixed values of the retention rules: bytes and percent.
SMALL_PACK, LEAST_WASTE, TARGET_PACK, WASTE_PERCENT = 256 << 10, 128 << 10, 4 << 20, 25
MAX_AGE_DAYS = 60


def classify_paths(files: DataFrame, unmanaged: str, immutable: str, managed: str) -> DataFrame:
    """files with class: the first of unmanaged, immutable and managed whose pattern the path fits, else none."""
    return files.withColumn(
        "class", F.when(F.col("path").rlike(unmanaged), "unmanaged").when(F.col("path").rlike(immutable), "immutable").when(F.col("path").rlike(managed), "managed").otherwise("none")
    )


def merge_snapshots(parts: DataFrame) -> DataFrame:
    """(path, hash) of parts(path, seq, hash): by path, the latest."""
    return parts.groupBy("path").agg(F.max_by("hash", "seq").alias("hash"))


def invalid_files(snapshot: DataFrame, listing: DataFrame, by: str = "hash") -> DataFrame:
    """(path) that are gone or differ. by: hash, mtime, or both (a changed time is forgiven if the hash holds)."""
    s, now = snapshot.alias("s"), listing.alias("n")
    differs = {
        "hash": "NOT s.hash <=> n.hash",
        "mtime": "NOT s.mtime <=> n.mtime",
        "both": "NOT s.mtime <=> n.mtime AND NOT s.hash <=> n.hash",
    }[by]
    return s.join(now, F.expr("s.path = n.path"), "left").where(f"n.path IS NULL OR ({differs})").select("s.path")


def still_missing(missing: DataFrame, listing: DataFrame) -> DataFrame:
    """(path) recorded as absent that is absent still."""
    return missing.select("path").join(listing.select("path"), "path", "left_anti")


def directory_digests(files: DataFrame) -> DataFrame:
    """(path, digest) of each directory over files(path, hash): its children's names and digests in order, bottom up.

    A directory's digest is the hash of its own lines ``name:digest``, sorted. Each level is written once and read
    by the next one above, so a tree costs as many steps as it is deep, however deep.
    """
    depth = F.size(F.split("path", "/"))
    nodes = settle(files.select("path", F.col("hash").alias("digest"), depth.alias("depth")))
    parent, name = F.regexp_replace("path", "/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    line = F.concat(name, F.lit(":"), F.coalesce("digest", F.lit("")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    levels: list[DataFrame] = []
    below = nodes.limit(0).drop("depth")
    for level in range(deepest, 1, -1):
        here = nodes.where(F.col("depth") == level).drop("depth").unionByName(below)
        above = here.groupBy(parent.alias("path")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
        below = settle(above.select("path", F.sha2(F.array_join("lines", "\n"), 256).alias("digest")))
        levels.append(below)
        if len(levels) > 16:  # one table for many levels: the last plan stays small
            together = settle(_union(levels[:-1]))
            drop(*levels[:-1])
            levels = [together, below]
    return _union(levels) if levels else below


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def change_hits(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """(path) that a change touches: changed itself, or above or below a changed context. changes: (path, kind).

    Ancestors are listed, so both directions are equi-joins on whole components.
    """
    above = F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    own = paths.select("path").distinct()
    exact = own.join(changes.where("kind != 'context'").select("path"), "path", "left_semi")
    contexts = changes.where("kind = 'context'").select("path").distinct()
    under = own.select("path", F.explode(above).alias("up")).join(contexts.select(F.col("path").alias("up")), "up", "left_semi").select("path")
    over = own.join(contexts.select(F.explode(above).alias("path")), "path", "left_semi")
    return exact.union(under).union(over).distinct()


def layered_lookup(asked: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """(key, etag, layer, payload): the first layer (0 first) that holds the key with the same etag, null where none does."""
    out, layer, payload = asked, F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, table in enumerate(layers):
        hit = table.select(F.col("key").alias(f"k{i}"), F.col("etag").alias(f"e{i}"), F.col("payload").alias(f"p{i}"))
        out = out.join(hit, (F.col("key") == F.col(f"k{i}")) & F.col("etag").eqNullSafe(F.col(f"e{i}")), "left")
    for i in reversed(range(len(layers))):
        there = F.col(f"k{i}").isNotNull()
        layer, payload = F.when(there, F.lit(i)).otherwise(layer), F.when(there, F.col(f"p{i}")).otherwise(payload)
    return out.select("key", "etag", layer.alias("layer"), payload.alias("payload"))


def promoted(hits: DataFrame) -> DataFrame:
    """Entries that a lookup found below the first layer, to be appended to it."""
    return hits.where("layer > 0").select("key", "etag", "payload")


def memory_kept(entries: DataFrame, completed: int, most_unused: int) -> DataFrame:
    return entries.where(F.lit(completed) - F.col("last_used") < most_unused)


def expired(entries: DataFrame, revision: int, now_s: int, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Entries unused since an earlier revision and older than the limit. last_access_s: epoch seconds."""
    unused = F.col("unused_since") < revision
    return entries.where(unused & (F.lit(now_s) - F.col("last_access_s") > max_age_days * DAY_S))


def compaction(entries: DataFrame) -> DataFrame:
    """(file, reason) of packs to rewrite. entries: (file, pack_size, length, unused_since)."""
    packs = entries.groupBy("file").agg(
        F.max("pack_size").alias("size"), F.sum("length").alias("live"), F.bool_or(F.col("unused_since").isNull()).alias("used")
    )
    small = packs.agg(F.count(F.when((F.col("size") <= SMALL_PACK) & F.col("used"), 1)).alias("n_small"))
    waste = F.greatest(F.col("size") - F.col("live"), F.lit(0))
    reason = (
        F.when((waste >= LEAST_WASTE) & (waste * 100 >= F.col("size") * WASTE_PERCENT), "waste")
        .when(F.col("size") > TARGET_PACK, "oversized")
        .when((F.col("size") <= SMALL_PACK) & F.col("used") & (F.col("n_small") >= 2), "small")
    )
    return packs.join(F.broadcast(small)).select("file", reason.alias("reason")).where("reason IS NOT NULL")  # one row


def pack_frames(frames: DataFrame, target: int = TARGET_PACK) -> DataFrame:
    """frames(shard, seq, used, length) with pack: filled in order up to the target, used and unused apart.

    The rule is sequential, so each shard (a writer's own frames) is one group.
    """
    import pandas as pd

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["used", "seq"], ascending=[False, True])
        pack, size, last, out = -1, 0, None, []
        for used, length in zip(rows["used"], rows["length"], strict=True):
            if last is None or used != last or size + length > target:
                pack, size = pack + 1, 0
            size, last = size + length, used
            out.append(pack)
        return rows.assign(pack=out)

    return frames.groupBy("shard").applyInPandas(fill, "shard long, seq long, used boolean, length long, pack int")


def signature(*parts: Column) -> Column:
    """A digest that is equal if and only if all parts are; nulls and empty strings differ."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def module_signatures(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, signature) over source hash, error and the ordered outgoing edges."""
    out = edges.groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_list(F.struct("block_index", "dep_index", "dst"))).alias("edges"))
    return modules.join(out, "module", "left").select("module", signature(F.col("source_hash"), F.col("error"), F.col("edges")).alias("signature"))


def memo_validity(old: DataFrame, new: DataFrame) -> DataFrame:
    """(module, graph_ok, codegen_ok): a changed graph signature clears both stages, changed ids only the second."""
    a, b = old.alias("a"), new.alias("b")
    j = b.join(a, "module", "left")
    graph = F.col("a.graph").eqNullSafe(F.col("b.graph")) & F.col("a.graph").isNotNull()
    return j.select("module", graph.alias("graph_ok"), (graph & F.col("a.ids").eqNullSafe(F.col("b.ids"))).alias("codegen_ok"))


def guard_failures(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(name) of the guards(name, value) that differ from those a cache was made under, or are on one side only; none: it may be used."""
    s, n = stored.alias("s"), now.alias("n")
    return s.join(n, "name", "full").where("NOT s.value <=> n.value OR s.value IS NULL").select("name")


#: Milliseconds from a build to the writing of its cache.
FLUSH_MS = {"initial": 5000, "ordinary": 60000, "large": 1000}


def flush_times(builds: DataFrame) -> DataFrame:
    """(cache, flush_ms): when each cache is due, by the earliest of its builds(cache, kind, end_ms)."""
    delay = F.create_map(*[F.lit(x) for kv in FLUSH_MS.items() for x in kv])
    return builds.groupBy("cache").agg(F.min(F.col("end_ms") + delay[F.col("kind")]).alias("flush_ms"))


def stored(layers: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """Each layer(key, etag, payload) with the new entries in place of those of their keys: a write goes through all."""
    rows = new.select("key", "etag", "payload")
    return [layer.select("key", "etag", "payload").join(rows.select("key"), "key", "left_anti").unionByName(rows) for layer in layers]


def invalid_managed(snapshot: DataFrame, packages: DataFrame) -> DataFrame:
    """(root) of snapshot(root, name, version) whose package is gone or another one now; other files below it aren't looked at."""
    s, now = snapshot.alias("s"), packages.alias("n")
    differs = F.expr("n.root IS NULL OR NOT (s.name <=> n.name AND s.version <=> n.version)")
    return s.join(now, F.expr("s.root = n.root"), "left").where(differs).select("s.root")


def module_hashes(modules: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(module, hash): equal if and only if identity, source hash, error, used names, own id and the ids of all targets in
    the order of their edges are. modules: (module, identity, source_hash, error, used), edges: (src, seq, dst), ids: (module, id)."""
    targets = edges.join(ids.select(F.col("module").alias("dst"), F.col("id").alias("target")), "dst", "left")
    targets = targets.groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_list(F.struct("seq", "target"))).alias("targets"))
    out = modules.join(ids.select("module", "id"), "module", "left").join(targets, "module", "left")
    return out.select("module", signature(*(F.col(c) for c in ("identity", "source_hash", "error", "used", "id", "targets"))).alias("hash"))


def asset_etags(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """(chunk, etag) over the hashes of a chunk's modules, in the order of the modules."""
    rows = members.select("chunk", "module").distinct().join(hashes, "module")
    listed = F.array_sort(F.collect_list(F.struct("module", "hash")))
    return rows.groupBy("chunk").agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["hash"]), ","), 256).alias("etag"))
