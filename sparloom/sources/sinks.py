"""Writers: delimited text, JSON lines, one-row summaries, leaderboards, comparison tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, single: bool = False, encoding: str = "utf-8", mark: bool = False) -> None:
    """Cells as they are, white space around them too.  ``mark`` puts a byte-order mark at the start of each file, as
    spreadsheets want it."""
    out = df.select(*fields) if fields else df
    if mark:  # the header is what a file begins with
        out = out.withColumnRenamed(out.columns[0], f"\ufeff{out.columns[0]}")
    options = {"header": True, "escape": '"', "encoding": encoding, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (out.coalesce(1) if single else out).write.mode("overwrite").options(**options).csv(path)


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file with just this content, in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_jsonl(df: DataFrame, path: str, order: str | None = None, keep_nulls: bool = True) -> None:
    out = df.orderBy(order).drop(order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_summary(row: DataFrame, path: str) -> None:
    """One object in one file, indented, nulls written; more rows are an error."""
    found = row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"})).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"a summary has one row, not {len(found)}")
    write_text_file(row.sparkSession, path, json.dumps(json.loads(found[0][0]), ensure_ascii=False, indent=2) + "\n")


def upsert_leaderboard(old: DataFrame, new: DataFrame, key: str = "run_name", score: str = "micro_f1") -> DataFrame:
    """Old rows without those that are replaced, and the new ones, best first."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(F.desc(score), key)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or the one before it if a run was lost while it was swapped; None if there is neither."""
    jvm = spark.sparkContext._jvm
    for p in (path, path + ".old"):
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(p)
    return None


def save_leaderboard(spark: SparkSession, path: str, new: DataFrame, key: str = "run_name", score: str = "micro_f1") -> None:
    """Written beside the old table, which is renamed and goes last: at any time one of the two is whole."""
    jvm = spark.sparkContext._jvm
    at, side, aside = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = read_leaderboard(spark, path)
    table = upsert_leaderboard(old, new, key, score) if old is not None else new.orderBy(F.desc(score), key)
    table.coalesce(1).write.mode("overwrite").parquet(path + ".new")
    if fs.exists(at):
        fs.delete(aside, True)
        fs.rename(at, aside)
    fs.rename(side, at)
    fs.delete(aside, True)


def metric_pivot(table: DataFrame, runs: Sequence[str], metrics: Sequence[str], key: str = "run_name") -> DataFrame:
    """Metrics as rows, runs as columns, four decimals, rounded as Python and C do: by the exact value of the double.
    (``format_string`` rounds the shortest decimal text half up.)"""

    @F.pandas_udf("string")
    def four(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else format(v, ".4f") for v in values], dtype=object)

    long = table.unpivot([key], list(metrics), "metric", "value")
    wide = long.groupBy("metric").pivot(key, list(runs)).agg(F.first("value"))
    return wide.select("metric", *[four(F.col(f"`{r}`").cast("double")).alias(r) for r in runs])


def markdown_table(wide: DataFrame, order: Sequence[str], key: str = "metric") -> str:
    """The text of a small comparison table, rows in the order given."""
    rows = {r[key]: r for r in wide.collect()}  # a row a metric
    names = wide.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(rows[m][n] or "") for n in names) + " |" for m in order if m in rows])


def select_runs(table: DataFrame, runs: Sequence[str], key: str = "run_name") -> DataFrame:
    """The named runs in the order given; a run that isn't there is an error."""
    wanted = table.sparkSession.createDataFrame([(i, r) for i, r in enumerate(runs)], f"_i int, {key} string")
    missing = wanted.join(table.select(key), key, "left_anti").collect()
    if missing:
        raise ValueError(f"runs not found: {[r[key] for r in missing]}")
    return wanted.join(table, key).orderBy("_i").drop("_i")
