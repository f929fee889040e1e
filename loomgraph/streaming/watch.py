"""Changes as a stream: debounced batches, the latest kind of each path, what to watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = "20 milliseconds"
KINDS = {"file": 0, "context": 1, "missing": 2}


def watch_targets(targets: DataFrame) -> DataFrame:
    """(path, kind): each path once; of several kinds, missing before context before file."""
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return targets.groupBy("path").agg(F.max_by("kind", rank[F.col("kind")]).alias("kind"))


def not_ignored(changes: DataFrame, output_dir: str, substrings: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> DataFrame:
    out = changes.where(~((F.col("path") == output_dir) | F.startswith("path", F.lit(output_dir.rstrip("/") + "/"))))
    for s in substrings:
        out = out.where(~F.contains("path", F.lit(s)))
    for p in patterns:
        out = out.where(~F.col("path").rlike(p))
    return out


def debounce(changes: DataFrame, gap: str = GAP, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start, end, n, paths): changes whose neighbours are at most ``gap`` apart are one batch.

    Works on a stream (behind a watermark) and on a table alike. paths: the latest kind of
    each path, as path:kind in order.
    """
    window = F.session_window("ts", gap)
    rows = F.array_sort(F.collect_list(F.struct("path", "ts", "kind")))
    out = changes.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), rows.alias("rows"))
    last = F.filter("rows", lambda r, i: (i == F.size("rows") - 1) | (r["path"] != F.get("rows", i + 1)["path"]))
    return out.select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n",
        F.array_join(F.transform(last, lambda r: F.concat(r["path"], F.lit(":"), r["kind"])), ",").alias("paths"),
    )


def batches(stream: DataFrame, late: str = "10 seconds", gap: str = GAP) -> DataFrame:
    """:func:`debounce` of a stream; ``late`` is how long a batch waits for changes that arrive out of order."""
    # streaming session windows need a key beside the time; all changes of a stream have the same one
    one = stream.withWatermark("ts", late).withColumn("watcher", F.length("path") % 1)
    return debounce(one, gap, ("watcher",)).drop("watcher")


def run_batches(stream: DataFrame, build, checkpoint: str, late: str = "10 seconds", gap: str = GAP):
    """A query that calls ``build(changes)`` for each micro-batch that closed any: what arrives meanwhile waits for the next one."""

    def each(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            build(df)

    return batches(stream, late, gap).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).start()


def poll_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, kind) between two listings (path, mtime, size): modified (new ones too) or removed."""
    b, n = before.alias("b"), now.alias("n")
    j = b.join(n, "path", "full")
    gone, same = F.col("n.mtime").isNull(), F.expr("b.mtime <=> n.mtime AND b.size <=> n.size")
    return j.where(~same).select("path", F.when(gone, "removed").otherwise("modified").alias("kind"))


def reusable(records: DataFrame, hits: DataFrame) -> DataFrame:
    """records(owner, path) none of whose paths was hit, by owner."""
    touched = records.join(hits, "path", "left_semi").select("owner").distinct()
    return records.select("owner").distinct().join(touched, "owner", "left_anti")


def latest_kind(changes: DataFrame) -> DataFrame:
    """(path, kind): the last change of each path."""
    order = Window.partitionBy("path").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return changes.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("path", "kind")


def builds(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, full, n): runs(run, manual) with how many changes(run, path) they answer; the first run, one asked for by hand
    and one without changes build everything."""
    seen = changes.groupBy("run").agg(F.count_distinct("path").alias("n"))
    first = runs.agg(F.min("run").alias("first"))
    out = runs.join(seen, "run", "left").join(F.broadcast(first))  # one row
    full = (F.col("run") == F.col("first")) | F.coalesce("manual", F.lit(False)) | F.col("n").isNull()
    return out.select("run", full.alias("full"), F.when(full, 0).otherwise(F.col("n")).cast("long").alias("n"))


#: Log levels by rank, the most important first.
LEVELS = ["none", "error", "warn", "info", "log", "verbose"]


def logged(events: DataFrame, level: str = "none") -> DataFrame:
    """events(level, ...) up to the configured level; none by default."""
    return events.where(F.col("level").isin(*LEVELS[1 : LEVELS.index(level) + 1]))
