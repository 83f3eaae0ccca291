"""Ingest with progress that can be read: of every batch of a stream the parsed rows, the failed ids and a snapshot.

A batch writes to folders that bear its number, each overwritten, the snapshot last.  A batch without a snapshot
doesn't count, so a run that is lost between two writes leaves nothing half there, and a batch that runs again changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.streaming.landing import parse_landed

def landed_answers(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(cid, state, body) of JSON lines as ``batches.fetch`` gives them, as a stream."""
    return spark.readStream.schema("cid long, state string, body string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def _write(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)


def batch_writer(out: str, kinds: Sequence[str], write: Callable[[DataFrame, str], None] = _write) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows that are done and parse go to ``rows``, the ids of others to ``failed``."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            whole = F.col("state").eqNullSafe("done") & (F.col("body").isNull() | (F.col("body") == "") | F.try_parse_json("body").isNotNull())
            good = batch.filter(whole).select("cid", F.when(F.coalesce(F.col("body"), F.lit("")) == "", "{}").otherwise(F.col("body")).alias("body"))
            write(parse_landed(good, kinds), f"{out}/rows/batch={number}")
            write(batch.filter(~whole).select("cid", F.coalesce("state", F.lit("failed")).alias("state")), f"{out}/failed/batch={number}")
            before = batch.sparkSession.read.parquet(f"{out}/snapshots/batch={number - 1}").first() if number else None  # one row
            counts = batch.agg(F.count_if(whole).alias("n_rows"), F.count_if(~whole).alias("n_failed"))
            sums = [(F.col(f"n_{x}") + F.lit(before[f"all_{x}"] if before else 0)).alias(f"all_{x}") for x in ("rows", "failed")]
            write(counts.select("n_rows", "n_failed", *sums), f"{out}/snapshots/batch={number}")
        finally:
            batch.unpersist()

    return one


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, kinds: Sequence[str] = ("hazards",), files_per_trigger: int = 100, write: Callable[[DataFrame, str], None] = _write) -> None:
    """Takes what has landed since the last call; goes on where a lost run was."""
    stream = landed_answers(spark, path, files_per_trigger)
    query = stream.writeStream.foreachBatch(batch_writer(out, kinds, write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def snapshots(spark: SparkSession, out: str) -> DataFrame:
    """Of every finished batch: its number, its own counts, and those of all batches up to it."""
    return spark.read.option("basePath", f"{out}/snapshots").parquet(f"{out}/snapshots").select(F.col("batch").cast("long").alias("batch"), "n_rows", "n_failed", "all_rows", "all_failed")


def finished(spark: SparkSession, out: str, part: str = "rows") -> DataFrame:
    """``rows`` or ``failed`` of the batches that have a snapshot."""
    done = snapshots(spark, out).select(F.col("batch").alias("_done"))  # a row a batch
    found = spark.read.option("basePath", f"{out}/{part}").parquet(f"{out}/{part}")
    return found.join(F.broadcast(done), F.col("batch").cast("long") == F.col("_done"), "left_semi").drop("batch")
