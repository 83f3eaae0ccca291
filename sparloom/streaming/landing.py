"""Resumable ingest: landed response files as a stream, each file read once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.sources import documents


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(cid, body, file): JSON documents, one a file named by its id."""
    raw = spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    file = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(file, r"(\d+)\.json$", 1).try_cast("bigint").alias("cid"), F.col("value").alias("body"), file.alias("file"))


#: Parsers by name; each takes documents with an id and gives one row a document.
PARSERS = {"hazards": documents.parse_hazards, "properties": documents.parse_properties, "toxicity": documents.parse_toxicity}


def parse_landed(rows: DataFrame, kinds: Sequence[str] = ("hazards",)) -> DataFrame:
    """The columns of all parsers asked for, side by side, from one reading of each document."""
    out = documents.parse_json(rows, "body").select("cid", "document")
    for kind in kinds:
        out = PARSERS[kind](out.withColumn("_kept", F.struct(*out.columns)), "_kept")
        out = out.select("_kept.*", *[c for c in out.columns if c != "_kept"])
    return out.drop("document")


def ingest(spark: SparkSession, path: str, table_path: str, checkpoint: str, kinds: Sequence[str] = ("hazards",)) -> None:
    """Parses what has landed since the last call and appends it; progress is in the checkpoint, so a lost
    run goes on where it was, and nothing is parsed or written twice."""
    rows = parse_landed(landed_stream(spark, path), kinds)
    query = rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
