"""Readers of the engine's inputs: delimited text, JSON lines, landed service responses, metrics, files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.functions.lineage import cut
from sparloom.functions.text import normalize_text

#: Fixed value: encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gb18030", "gbk", "iso-8859-1")
SPARK_ENCODINGS = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "utf-8", empty_as: str | None = None) -> DataFrame:
    """All columns as text, or by ``schema``; quoted line breaks belong to a cell; a byte-order mark is no
    part of the first header.  ``empty_as`` fills null cells of text columns."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", False)
    if encoding.lower() in SPARK_ENCODINGS:
        df = reader.csv(path)
    else:  # Spark takes further encodings only with a setting; it holds while the file is read, and no longer
        name = "spark.sql.legacy.javaCharsets"
        said = spark.conf.get(name)
        spark.conf.set(name, "true")
        try:
            df = cut(reader.csv(path))
        finally:
            spark.conf.set(name, said)
    return df if empty_as is None else df.fillna(empty_as)


def guess_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding in which every file under ``path`` decodes; files are tried where they are read."""

    def decodes(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for content in batch.column(0).to_pylist():
                for i, name in enumerate(ENCODINGS):
                    try:
                        content.decode(name)
                    except UnicodeDecodeError:
                        continue
                    out.append(i)
                    break
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["i"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decodes, "i int").agg(F.max("i")).first()[0]
    return ENCODINGS[found or 0]


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """Text columns in the first encoding that fits, every cell normalised; null cells are empty."""
    df = read_csv(spark, path, encoding=guess_encoding(spark, path))
    return df.select(*[normalize_text(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are left out and a malformed line is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_ids(spark: SparkSession, path: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(cid): a range, both ends included, or the lines of a file that are digits."""
    if path is None:
        return spark.range(start, end + 1).toDF("cid")
    return spark.read.text(path).select(F.trim("value").alias("v")).filter(F.col("v").rlike(r"^\d+$")).select(F.col("v").cast("bigint").alias("cid"))


def read_workbook_export(spark: SparkSession, path: str, row_column: str = "nite_source_row", ordinal: str = "_ordinal") -> DataFrame:
    """A sheet exported as CSV or Parquet with an ordinal column from 0; sheet rows start at 2."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)
    return df.withColumn(row_column, F.col(ordinal).cast("bigint") + 2).drop(ordinal)


def read_cas_exchange(spark: SparkSession, path: str) -> DataFrame:
    """(cas, cids): landed two-column text, sorted distinct numbers; cells that are no number go."""
    rows = spark.read.option("sep", "\t").schema("cas string, cid string").csv(path)
    return rows.withColumn("cid", F.col("cid").try_cast("bigint")).groupBy("cas").agg(F.sort_array(F.collect_set("cid")).alias("cids"))


def missing_ids(ids: DataFrame, cached: DataFrame, key: str = "cid") -> DataFrame:
    """What a cache lacks: the only ids to ask for."""
    return ids.join(cached.select(key).distinct(), key, "left_anti")


def find_metrics(spark: SparkSession, folder: str) -> list[str]:
    """``*_metrics.json`` in a folder, or else in the folders below it, or else their ``metrics.json``."""
    jvm = spark.sparkContext._jvm
    for pattern in ("*_metrics.json", "*/*_metrics.json", "*/metrics.json"):
        at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        if found is not None and len(found):
            return sorted(f.getPath().toString() for f in found)
    return []


def read_metrics(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(run_name, metrics) of metric files.  Names come from ``<run>_metrics.json``, or from the folder of a
    plain ``metrics.json``; metrics nested under test are taken out."""
    # the path comes encoded
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = spark.read.text(list(paths), wholetext=True).select("value", path.alias("p"))
    file, folder = F.element_at(F.split("p", "/"), -1), F.element_at(F.split("p", "/"), -2)
    name = F.when(file == "metrics.json", folder).otherwise(F.regexp_replace(file, r"_metrics\.json$", ""))
    flat = F.from_json("value", "map<string,string>")
    nested = F.from_json(F.get_json_object("value", "$.test.metrics"), "map<string,string>")
    return raw.select(name.alias("run_name"), F.coalesce(nested, flat).alias("metrics"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
