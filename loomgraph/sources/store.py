"""A versioned table: each revision is a folder, and a small pointer names the one that counts.

Readers see the old or the new revision and never a part of one, on any file system that
Spark writes to. A revision that was never pointed at stays unread; the next one gets a new folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published first."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, path = _files(spark, root)
    at = path(f"{root}/_pointers")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def revision(spark: SparkSession, root: str) -> int:
    """The newest published revision; 0 where there is none."""
    return max(_pointers(spark, root), default=0)


def publish(df: DataFrame, root: str, seen: int, compression: str = "zstd") -> int:
    """Write df as the revision after ``seen``, the one it was made from; :class:`Conflict` if that is no longer the newest.

    compression: a codec of Parquet that Spark has, none and gzip among them; readers need not know it.
    """
    spark = df.sparkSession
    fs, path = _files(spark, root)
    folder = f"data-{uuid.uuid4().hex}"
    if revision(spark, root) != seen:
        raise Conflict(f"{root}: revision {seen} is no longer the newest")
    df.write.option("compression", compression).parquet(f"{root}/{folder}")
    try:
        # creating without overwriting is what decides between two writers
        out = fs.create(path(f"{root}/_pointers/{seen + 1}"), False)
    except Exception as e:
        fs.delete(path(f"{root}/{folder}"), True)
        raise Conflict(f"{root}: revision {seen + 1} was published by another writer") from e
    out.write(bytearray(folder.encode()))
    out.close()
    return seen + 1


@contextmanager
def sole_writer(spark: SparkSession, root: str, owner: str, most_age_s: float | None = None) -> Iterator[None]:
    """Hold the table's writer marker; :class:`Conflict` while another owner holds it.

    A marker of the same owner, or one older than ``most_age_s``, was left by a run that was lost, and is taken over. The
    marker keeps writers from doing work twice; what a reader sees is settled by :func:`publish` alone.
    """
    fs, path = _files(spark, root)
    at = path(f"{root}/_writer/owner")
    if fs.exists(at):
        held = spark.read.text(f"{root}/_writer/owner").first()
        age = time.time() - fs.getFileStatus(at).getModificationTime() / 1000
        if held and held[0] != owner and (most_age_s is None or age <= most_age_s):
            raise Conflict(f"{root}: {held[0]} is writing")
        fs.delete(at, False)
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise Conflict(f"{root}: another writer came first") from e
    out.write(bytearray(owner.encode()))
    out.close()
    try:
        yield
    finally:
        fs.delete(at, False)


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame | None:
    """The table at a revision, the newest by default; None where nothing was published."""
    at = at or revision(spark, root)
    if not at:
        return None
    folder = spark.read.text(f"{root}/_pointers/{at}").first()[0]
    return spark.read.parquet(f"{root}/{folder}")


def discard_old(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest revisions, pointers last."""
    fs, path = _files(spark, root)
    for at in _pointers(spark, root)[:-keep] if keep else _pointers(spark, root):
        folder = spark.read.text(f"{root}/_pointers/{at}").first()[0]
        fs.delete(path(f"{root}/{folder}"), True)
        fs.delete(path(f"{root}/_pointers/{at}"), False)
