"""Registered queries over what comes from outside (workbooks, batches of ids, landed answers) and over what goes to
training (masked and padded batches, medians)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from sparloom.functions.lineage import through_files
from sparloom.operators import batching, medians
from sparloom.plans.contract import _register, _table
from sparloom.plans.workflows import _HAZARDS_SQL, _documents
from sparloom.sources import batches, workbook
from sparloom.streaming import progress

#: Rows of a workbook in the query.
PER_FILE = 500


@_register(
    f"""SELECT c_custkey % {PER_FILE} + 2 AS source_row, c_custkey::VARCHAR AS "c_custkey", CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name || ' <&> "é"' || chr(10) || ' x ' END AS name,
CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS nation, CASE WHEN c_custkey % 3 = 0 THEN 'TRUE' ELSE 'FALSE' END AS third FROM customer"""
)
def workbook_cells(spark, sf_dir):
    """Customers written as workbooks and read back: blank cells, numbers, truth values, texts with marks and line ends."""
    k = F.col("c_custkey")
    t = _table(spark, sf_dir, "customer").select(
        k.cast("long").alias("c_custkey"),
        F.when(k % 7 != 0, F.concat("c_name", F.lit(' <&> "é"\n x '))).alias("name"),
        F.when(k % 11 != 0, F.col("c_nationkey").cast("long")).alias("nation"),
        (k % 3 == 0).alias("third"),
    )
    return through_files(spark, lambda p: workbook.write_workbooks(t, p, F.floor(k / PER_FILE), ["c_custkey"]), lambda p: workbook.read_workbook(spark, p))


def _reply(ids: Sequence[int]) -> tuple[int, dict[int, str]]:
    """A transport that knows every id but those that end in 3, and never answers where the first id's last two digits
    are below 20."""
    if ids[0] % 100 < 20:
        return batches.BUSY, {}
    return batches.OK, {i: json.dumps({"id": i}) for i in ids if i % 10 != 3}


_BATCH_SQL = "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 10 AS batch FROM part"


@_register(
    f"""WITH b AS ({_BATCH_SQL}), f AS (SELECT *, min(p_partkey) OVER (PARTITION BY batch) % 100 < 20 AS lost FROM b)
SELECT p_partkey AS cid, batch, CASE WHEN lost THEN 'failed' ELSE 'done' END AS state, CASE WHEN lost THEN 3 ELSE 1 END::INT AS attempts, CASE WHEN lost THEN 503 ELSE 200 END::INT AS status,
CASE WHEN lost THEN NULL WHEN p_partkey % 10 = 3 THEN '' ELSE '{{"id": ' || p_partkey || '}}' END AS body FROM f"""
)
def batch_answers(spark, sf_dir):
    """All parts asked for in batches of ten, each of them answered, found empty, or failed after three attempts."""
    ids = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cid"))
    return batches.fetch(ids, _reply, size=10, backoff=batches.Backoff(sleep=lambda seconds: None))


_FAILED = "p_partkey % 13 = 5"


@_register(f"SELECT p_partkey AS cid, {_HAZARDS_SQL}, 'row' AS part, (SELECT count(*) FROM part WHERE NOT ({_FAILED})) AS all_rows, (SELECT count(*) FROM part WHERE {_FAILED}) AS all_failed FROM part WHERE NOT ({_FAILED}) UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'failed', (SELECT count(*) FROM part WHERE NOT ({_FAILED})), (SELECT count(*) FROM part WHERE {_FAILED}) FROM part WHERE {_FAILED}")
def landed_progress(spark, sf_dir):
    """Answers for all parts, landed as files and taken by a stream in several batches: rows, failed ids, and the last
    snapshot's sums beside each of them."""
    p = F.col("cid")
    answers = _documents(spark, sf_dir).select("cid", F.when(p % 13 == 5, "failed").otherwise("done").alias("state"), F.when(p % 13 != 5, F.col("body")).alias("body"))

    def land(path):
        answers.repartition(6, "cid").write.json(f"{path}/landed")
        progress.ingest(spark, f"{path}/landed", f"{path}/out", f"{path}/progress", files_per_trigger=2)

    def taken(path):
        last = progress.snapshots(spark, f"{path}/out").agg(F.max_by("all_rows", "batch").alias("all_rows"), F.max_by("all_failed", "batch").alias("all_failed"))
        rows = progress.finished(spark, f"{path}/out").withColumn("part", F.lit("row"))
        failed = progress.finished(spark, f"{path}/out", "failed").select("cid", F.lit("failed").alias("part"))
        return rows.unionByName(failed, allowMissingColumns=True).crossJoin(F.broadcast(last))  # one row

    return through_files(spark, land, taken)


# ---- training ------------------------------------------------------------------------------------------

#: Words as tokens: 31 bits of a digest each, so that SQL can make the same.
_MAX, _SIZE, _STEP = 256, 8, 64
_TOKENS = "list_transform(list_filter(string_split_regex({}, '[ \\n]+'), lambda w: w <> ''), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT // 2)::INT)[:256]"
_CHAT = "string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text)"


def _word_tokens(text):
    return F.transform(F.filter(F.split(text, "[ \n]+"), lambda w: w != ""), lambda w: F.shiftright(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), 1).cast("int"))


@_register(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM conversations),
t AS (SELECT conv_id, {_CHAT} AS whole, coalesce({_CHAT} FILTER (WHERE NOT last) || chr(10) || chr(10), '') || 'ASSISTANT:' AS prompt FROM c GROUP BY conv_id),
k AS (SELECT conv_id, {_TOKENS.format("whole")} AS ids, len({_TOKENS.format("prompt")}) AS n_prompt FROM t),
n AS (SELECT *, row_number() OVER (ORDER BY ceil(len(ids) / {_STEP}.0), md5(conv_id::VARCHAR), conv_id) - 1 AS n FROM k),
b AS (SELECT *, n // {_SIZE} AS batch, max(len(ids)) OVER (PARTITION BY n // {_SIZE}) AS longest FROM n),
p AS (SELECT conv_id, batch, (n % {_SIZE})::INT AS place, longest, ids || list_resize([]::INT[], longest - len(ids), 0) AS input_ids, list_resize([]::INT[], len(ids), 1) || list_resize([]::INT[], longest - len(ids), 0) AS mask,
  list_resize([]::INT[], least(n_prompt, len(ids)), -100) || ids[n_prompt + 1:] || list_resize([]::INT[], longest - len(ids), -100) AS labels FROM b)
SELECT conv_id, batch, place, longest::INT AS longest, array_to_string(input_ids, ',') AS input_ids, array_to_string(mask, ',') AS attention_mask, array_to_string(labels, ',') AS labels FROM p"""
)
def training_batches(spark, sf_dir):
    """Conversations with the loss on the last turn alone, in padded batches of about one length."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    records = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    rows = batching.masked(records, _word_tokens, _MAX).drop("messages")
    made = batching.padded_batches(rows, "conv_id", _SIZE, F.md5(F.col("conv_id").cast("string").cast("binary")), _STEP)
    return made.select("conv_id", "batch", "place", F.size("input_ids").alias("longest"), *[F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "labels")])


_MIDDLES = [f"CASE WHEN l_orderkey % {k + 3} = 0 THEN NULL ELSE {c} * {k % 3 - 1 or 1} + {k % 4} END" for k in range(5) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]


@_register(" UNION ALL ".join(f"SELECT {i} AS n, round(quantile_cont(({m})::DOUBLE, 0.5), 6) AS median FROM lineitem" for i, m in enumerate(_MIDDLES)))
def exact_medians(spark, sf_dir):
    """Medians of twenty columns with ties and nulls, in the same passes."""
    t = _table(spark, sf_dir, "lineitem").select(*[F.expr(f"CAST({m} AS DOUBLE)").alias(f"m{i}") for i, m in enumerate(_MIDDLES)])
    found = medians.medians(t, t.columns)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(found.values())], "n int, median double")
