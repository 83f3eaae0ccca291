"""The contract queries over the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm import decontaminate, disclosure, hard_negatives, html_text, lz_fingerprint, mixing, pieces, quality, sharding, simhash, token_counts, token_files, whitening
from sparloom.llm.common import delete_path, shared_folder, table

SHARDS = tuple(f"shard-{i:03d}" for i in range(48))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign_shards(docs, "doc_id", SHARDS)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id", "n_links")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(disclosure.find_personal_data(table(spark, sf_dir, "documents")))


def sanitised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 9 makes of the texts: entities and disclosing terms generalised or removed."""
    return disclosure.sanitise(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files go to a folder of their own in the shared one, and away once they have been read back."""
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    try:
        return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    finally:
        delete_path(spark, path)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's relabelling, then the operator."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), "vec_id % 100 = 0")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_sharding": op2_sharding,
        "op3_simhash": op3_simhash,
        "op4_html_text": op4_html_text,
        "op5_token_counts": op5_token_counts,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_lz_fingerprint": op8_lz_fingerprint,
        "op9_disclosure": op9_disclosure,
        "op10_token_files": op10_token_files,
        "op11_pieces": op11_pieces,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_whitening": op13_whitening,
        "sanitised_documents": sanitised_documents,
    }


#: Fixed by the operators' defaults: 48 shards over 65,537 slots; target shares as the square root of counts, seed 7.
_MIXING_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * sqrt(n) / (SELECT sum(sqrt(n)) FROM n) / n AS rate FROM n),
w AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM w WHERE k < ceil(rate + 40 * sqrt(rate) + 60)),
u AS (SELECT d.*, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0 AS u FROM documents d),
m AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (w.c <= u.u) AS copies FROM u JOIN w ON w.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
e AS (SELECT * EXCLUDE (copies), unnest(range(copies))::INT AS copy_no FROM m)
SELECT *, md5('7s:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS shuffle_key FROM e"""


#: Fixed by the contract: anchors, relabelling, five positives, ten negatives, windows of 30 to 90 percent.
_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def _sharding_sql() -> str:
    """The lookup table as a list of shard numbers; the placement is worked out by the SQL."""
    number = {s: i for i, s in enumerate(SHARDS)}
    owners = ",".join(str(number[s]) for s in sharding.lookup_table(SHARDS))
    return f"""WITH t AS (SELECT [{owners}] AS owner), d AS (SELECT doc_id, source, n_chars, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 65537 AS slot FROM documents)
SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 3, '0') AS shard FROM d, t"""


def oracle_sql() -> dict[str, str]:
    """Hashes of n-grams, fingerprints, trees and tokenizers are beyond SQL: those queries are held against
    brute-force versions in the tests."""
    return {"op2_sharding": _sharding_sql(), "op7_mixing": _MIXING_SQL, "op12_hard_negatives": _NEGATIVES_SQL}
