"""Written tables that cut lineage, in the folder every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
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


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int = 2000) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Unlike ``persist`` this survives the loss of executors, and unlike a plain
    plan it is evaluated once, so later jobs see the same rows. Python code behind it
    gets at most ``batch_rows`` rows at a time, which bounds its memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(batch_rows, int(before))) if int(before) > 0 else str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    spark._jvm.System.gc()  # the shuffle files behind it are of no more use; the driver's collector frees them
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_loom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = df.sparkSession._jsc.hadoopConfiguration()
            target.getFileSystem(conf).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Groups of ids that are looked at together for repeats.
ID_GROUPS = 4096
_ABOVE = 1 << 62


def row_key(rows: DataFrame, id_col: str, text_col: str) -> Column:
    """A long that tells rows apart: the id, but a hash of id and text where an id is null or repeated.

    Such rows come behind all ids below 2**62, and those that are equal share a key. Which ids repeat
    is told by ``ID_GROUPS`` bits: an id that shares a group with a repeated one is hashed too.
    """
    known = rows.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL")
    group = F.pmod(F.xxhash64("id"), F.lit(ID_GROUPS))
    again = known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(group.cast("int").alias("g")).distinct()
    marks = bytearray(b"0" * ID_GROUPS)
    for r in again.collect():  # ID_GROUPS rows at most
        marks[r["g"]] = ord("1")
    own = F.col(f"`{id_col}`")
    place = F.pmod(F.xxhash64(own), F.lit(ID_GROUPS)).cast("int") + 1
    hashed = F.xxhash64(own, F.col(f"`{text_col}`")).bitwiseAND(_ABOVE - 1).bitwiseOR(_ABOVE)
    repeated = F.substring(F.lit(marks.decode()), place, F.lit(1)) == "1" if ord("1") in marks else F.lit(False)
    return F.when(own.isNull() | repeated, hashed).otherwise(own)


def hash_sample(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About ``most`` of the rows, those whose keys have the smallest hashes; all where there are no more.

    A threshold, not a sort: no task sees more than its own rows. Rows of equal keys stay together,
    so callers group by them first.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.xxhash64(*keys) < int((most / n - 0.5) * 2.0**64))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator needs, under its own names: others can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in names.items()])
