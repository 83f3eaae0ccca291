"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and rereads it as the next stage's documents.  All stages but the last return the columns
of ``documents``.  Filters tell rows apart by a digest of id and text, so null and repeated ids lose no row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparloom.llm import decontaminate, mixing, quality, simhash, token_files
from sparloom.llm.common import delete_path, path_exists, shared_folder, table
from sparloom.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance sample go, rows without an id or with a repeated one each by its text.
    Null and empty texts have weight 0 and are judged by it.  An empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; null and empty texts are
    one group.  Rows without an id are members like others and stay only in groups without any id."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go, rows without an id or with a repeated one each by its
    text.  Null and empty texts stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their source's rate, in a global random order; copies keep their id.  A null source is
    one of its own; null ids draw alike."""
    return mixing.mix_sources(docs).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of ``docs``, so that the mixing holds in them, and what they hold when read back:
    a row a document, with ``path``, ``file`` and ``first`` saying where its identifiers are.  The files stay;
    null and empty texts have the end id alone."""
    path = f"{shared_folder(spark)}/token-files/{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, tokenizer_path("byte_bpe_50k.json"), by_id=False)
    return token_files.read_token_files(spark, path).selectExpr("*", f"'{path}' AS path")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: Hashed models, fingerprints and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.  ``folder`` (below the shared folder; a new one by default) keeps the
    stages' results until the next one is there: a run that is given the folder of one that was lost goes on
    after the last finished stage.  It must be one over the same tables."""
    docs = table(spark, sf_dir, "documents")
    base = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{base}/{i}-{name}" for i, (name, _) in enumerate(STAGES)]
    done = max((i for i, p in enumerate(paths) if path_exists(spark, f"{p}/_SUCCESS")), default=-1)
    for i, (_, stage) in enumerate(STAGES):
        if i >= done:
            if i > done:
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[i])
            docs = spark.read.parquet(paths[i])
            if i:
                delete_path(spark, paths[i - 1])
    return docs
