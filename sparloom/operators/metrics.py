"""Multi-label metrics over long rows (id, label, truth, pred[, mask])."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.operators.gates import GateError


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(long: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """tp, fp, fn, tn; rows of unknown truth or prediction count nowhere."""
    t, p = F.col("truth"), F.col("pred")
    return long.groupBy(*by).agg(F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"))


def per_label(long: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    return rates(confusion(long, by)).withColumn("support", F.col("tp") + F.col("fn"))


def micro_macro(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro rates over all cells and macro means over labels (f1 averaged), from one pass by label."""
    labels = per_label(long, (*by, "label"))
    sums = labels.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return rates(sums).withColumnsRenamed({c: f"micro_{c}" for c in ("precision", "recall", "f1")})


def subset_hamming(long: DataFrame, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(n_rows, subset_accuracy, hamming_loss): rows all of whose cells agree; cells that don't."""
    rows = long.groupBy(*by, id_col).agg(F.count_if(F.col("truth") != F.col("pred")).alias("wrong"), F.count(F.lit(1)).alias("cells"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), ratio(F.count_if(F.col("wrong") == 0), F.count(F.lit(1))).alias("subset_accuracy"), ratio(F.sum("wrong"), F.sum("cells")).alias("hamming_loss")
    )


def fill_failures(long: DataFrame) -> tuple[DataFrame, Column]:
    """The internal policy: a failed answer counts as all zero.  Returns the rows and the failure count."""
    return long.withColumn("pred", F.coalesce("pred", F.lit(0))), F.count_if(F.col("pred").isNull())


def error_rows(long: DataFrame, id_col: str) -> DataFrame:
    """Rows with any wrong cell: id, gold and pred as text in label order."""
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", F.col(c).cast("string").alias("v")))), lambda x: F.concat(x["label"], F.lit("="), x["v"])), ",")
    rows = long.groupBy(id_col).agg(F.count_if(F.col("truth") != F.col("pred")).alias("n_wrong"), side("truth").alias("gold"), side("pred").alias("predicted"))
    return rows.filter("n_wrong > 0")


def masked_metrics(long: DataFrame) -> DataFrame:
    """Per label over cells with mask 1: a prediction that isn't 0 or 1 is left out and counted; unknown
    truth under the mask is an error."""
    on = long.filter("mask = 1")
    truth = F.when(F.col("truth").isNull(), F.raise_error(F.lit("unknown truth under the mask")).cast("int")).otherwise(F.col("truth"))
    t, p = F.col("truth"), F.col("pred")
    scored = p.isin(0, 1)
    counts = (
        on.withColumn("truth", truth)
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("valid"),
            F.count_if(scored).alias("scored"),
            F.count_if(~F.coalesce(scored, F.lit(False))).alias("excluded"),
            F.count_if((t == 1) & (p == 1)).alias("tp"),
            F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p == 0)).alias("fn"),
            F.count_if((t == 0) & (p == 0)).alias("tn"),
        )
    )
    return rates(counts)


def masked_summary(per: DataFrame) -> DataFrame:
    """One row: micro rates and accuracy, macro f1 over labels with scored cells, counters."""
    sums = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "valid", "scored", "excluded")], F.coalesce(F.avg(F.when(F.col("scored") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
    return rates(sums).withColumnsRenamed({c: f"micro_{c}" for c in ("precision", "recall", "f1")}).withColumn("micro_accuracy", ratio(F.col("tp") + F.col("tn"), F.col("scored")))


def top_codes(rows: DataFrame, codes: str, order: str, k: int = 20) -> DataFrame:
    """(code, n): the most frequent, ties by first appearance."""
    each = rows.select(F.col(order).alias("_o"), F.posexplode(codes).alias("_i", "code"))
    return each.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "_i")).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).select("code", "n")


def label_cardinality(rows: DataFrame, labels: str) -> DataFrame:
    return rows.groupBy(F.size(labels).alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(rows: DataFrame, labels: str) -> DataFrame:
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def split_label_counts(df: DataFrame, labels: Sequence[str], split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("int")).alias(c) for c in labels])


def coverage(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """(name, n, share) of rows that meet each condition, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return row.unpivot(["_all"], list(flags), "name", "n").select("name", "n", ratio(F.col("n"), F.col("_all")).alias("share"))


def tri_state_summary(long: DataFrame) -> DataFrame:
    """(label, valid, positive, negative) of rows (label, truth) with unknown truth as null."""
    return long.groupBy("label").agg(F.count("truth").alias("valid"), F.count_if(F.col("truth") == 1).alias("positive"), F.count_if(F.col("truth") == 0).alias("negative"))


def field_counts(df: DataFrame, fields: str) -> DataFrame:
    """How many rows have each key of a map column."""
    return df.select(F.explode(F.map_keys(fields)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def feature_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n): rows in which each column has a value, in one pass."""
    return df.agg(*[F.count(c).alias(c) for c in features]).unpivot([], list(features), "feature", "n")


def status_histogram(df: DataFrame, status: str = "parse_status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def require_equal_counters(table: DataFrame, model: str, counters: Sequence[str], models: int) -> DataFrame:
    """All models there, each once, with the same counters."""
    r = table.agg(F.count_distinct(F.struct(*counters)).alias("kinds"), F.count_distinct(model).alias("models"), F.count(F.lit(1)).alias("n")).first()
    if r["kinds"] != 1 or r["models"] != models or r["n"] != models:
        raise GateError(f"counters differ or models are missing: {r.asDict()}")
    return table


def contrast_deltas(table: DataFrame, pairs: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    """(new, base, metric, delta) for the pairs (new, base)."""
    long = table.unpivot([name], list(metrics), "metric", "value")
    new = long.select(F.col(name).alias("new"), "metric", F.col("value").alias("_new"))
    base = long.select(F.col(name).alias("base"), "metric", F.col("value").alias("_base"))
    return pairs.join(new, "new").join(base, ["base", "metric"]).select("new", "base", "metric", (F.col("_new") - F.col("_base")).alias("delta"))


def prompt_digest(records: DataFrame, order: str) -> DataFrame:
    """One digest of ids and turns but the answers: row digests, each with its place, summed up as four
    numbers, so that no group of texts is gathered; equal tables have equal digests."""
    return _digest_of_rows(records, order, _turns())


def _turns() -> Column:
    return F.to_json(F.filter("messages", lambda m: m["role"] != "assistant"))


def digested(records: DataFrame) -> DataFrame:
    """``records`` with a digest of the turns but the answers, ``turns``, in the messages' place: a narrow table that
    can be kept, where the texts would be written or put together again for each use."""
    return records.withColumn("turns", F.sha2(_turns(), 256)).drop("messages")


def _digest_of_rows(records: DataFrame, order: str, turns: Column) -> DataFrame:
    row = F.sha2(F.concat_ws("\x1f", F.col(order).cast("string"), "id", turns), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return records.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[part(i).cast("string") for i in range(4)]), 256).alias("digest"))


def gold_equivalence(a: DataFrame, b: DataFrame, order: str, labels: Sequence[str]) -> dict[str, object]:
    """Order, id set and labels of two gold tables, and their prompts' digests.  The tables are records or, if they are
    ``digested`` both, narrow ones."""
    if "turns" not in a.columns or "turns" not in b.columns:
        a, b = digested(a), digested(b)
    digest = lambda t: _digest_of_rows(t, order, F.col("turns")).first()[0]
    x = a.select("id", F.col(order).alias("_oa"), F.struct(*[f"labels.{n}" for n in labels]).alias("_la"))
    y = b.select("id", F.col(order).alias("_ob"), F.struct(*[f"labels.{n}" for n in labels]).alias("_lb"))
    r = x.join(y, "id", "full_outer").agg(
        F.count_if(F.col("_oa").isNull() | F.col("_ob").isNull()).alias("unpaired"), F.count_if(F.col("_oa") != F.col("_ob")).alias("moved"), F.count_if(F.col("_la") != F.col("_lb")).alias("relabelled")
    ).first()
    return {**r.asDict(), "same_prompts": digest(a) == digest(b)}


def run_status(gold: DataFrame | None, pred: DataFrame | None, key: str = "id") -> str:
    """missing_gold, missing_prediction, duplicate_ids, id_mismatch or evaluated."""
    from sparloom.operators.gates import id_mismatch

    if gold is None or gold.isEmpty():
        return "missing_gold"
    if pred is None or pred.isEmpty():
        return "missing_prediction"
    if any(d.groupBy(key).count().filter("count > 1").limit(1).count() for d in (gold, pred)):
        return "duplicate_ids"
    return "id_mismatch" if any(id_mismatch(gold, pred, key).values()) else "evaluated"
