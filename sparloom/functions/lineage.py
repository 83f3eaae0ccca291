"""Reliable lineage cuts and dense row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only a local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = getattr(spark, "_sparloom_folder", None) or "file://" + tempfile.mkdtemp(prefix="sparloom-files-")
        spark._sparloom_folder = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder.  Spark deletes it when the frame is no longer reachable, in sessions
    that ``sparloom.session`` builds."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def through_files(spark: SparkSession, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` gives of the files that ``write`` makes in a folder of their own, which then goes."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(path)
        return cut(read(path))
    finally:
        fs.delete(where, True)


def spread(df: DataFrame, *keys: str, each: int = 20_000) -> DataFrame:
    """``df`` in as many partitions as it has times ``each`` rows, dealt by ``keys``.  A table of short rows is a few
    bytes and so a split or two, however much is then done with each row or made of it."""
    parts = -(-df.count() // each)
    return df.repartition(parts, *keys) if parts > 1 else df


#: Rows with their columns that may be broadcast.
FEW = 20_000


def worked_out(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column], each: int = 20_000) -> DataFrame:
    """``df`` with columns that are told by its ``keys`` alone: each different combination is worked out once, ``each``
    of them to a task, and joined to its rows, nulls to nulls (by broadcast if they are FEW)."""
    names = [f"_key{i}" for i in range(len(keys))]
    different = cut(df.select(*keys).distinct())
    done = cut(spread(different, *keys, each=each).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c.alias(n) for n, c in columns.items()]))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return df.join(F.broadcast(done) if done.count() <= FEW else done, same).drop(*names)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, without a single-task window: a distributed sort
    is pinned, rows are counted by partition, and each row adds its place to its partition's offset."""
    pinned = cut(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row a partition
    sizes = {r["p"]: r["n"] for r in pinned.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _first long")
    return pinned.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_first") + place).drop("_p", "_first", "_at")
