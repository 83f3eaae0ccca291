"""Tables for outside models: (id, structure, labels) per split, and what was dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import records as R
from sparloom.functions import vocabulary as V
from sparloom.operators.gates import GateError, require_unique


def with_structure(records: DataFrame, field: str = "ConnectivitySMILES") -> DataFrame:
    return records.withColumn("smiles", R.field_value(R.user_content(F.col("messages")), field))


def multitask_rows(records: DataFrame, valid: Callable[[Column], Column] | None = None, labels: Sequence[str] = V.LABELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to write, gold kept, report).  Rows without a structure or with an invalid one go; the report
    has ``reason``, ``n`` and up to 20 of the smallest ids."""
    marked = with_structure(records)
    ok = F.coalesce(valid(F.col("smiles")), F.lit(False)) if valid else F.lit(True)
    marked = marked.withColumn("reason", F.when(F.col("smiles") == "", "missing").when(~ok, "invalid"))
    kept = marked.filter("reason is null")
    rows = kept.select("id", "smiles", *[F.col(f"labels.{n}").alias(n) for n in labels])
    dropped = marked.filter("reason is not null").select("reason", "id")
    counts = dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    few = None
    for reason in ("missing", "invalid"):
        some = dropped.filter(F.col("reason") == reason).orderBy("id").limit(20).groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
        few = some if few is None else few.unionByName(some)
    return rows, kept.drop("reason", "smiles"), counts.join(few, "reason")


def predict_input(records: DataFrame, valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, smiles), all or nothing: one missing or invalid structure blocks the output."""
    require_unique(records, "id")
    rows, _, report = multitask_rows(records, valid)
    bad = report.select("reason", "n").collect()  # two rows at most
    if bad:
        raise GateError(f"structures are missing or invalid: {[tuple(r) for r in bad]}")
    return rows.select("id", "smiles")
