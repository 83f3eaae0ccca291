"""Merging sources, resolving entities, keeping an evaluation set apart from a reference universe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import vocabulary as V
from sparloom.operators.gates import keep_last


def with_missing_columns(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Columns of ``spec`` (name to type) that ``df`` lacks, as nulls; known aliases are renamed first."""
    for name, names in V.ALIASES.items():
        if name in spec and name not in df.columns:
            found = next((n for n in names if n in df.columns), None)
            if found:
                df = df.withColumnRenamed(found, name)
    return df.withColumns({n: F.lit(None).cast(t) for n, t in spec.items() if n not in df.columns})


def left_merge(base: DataFrame, others: Sequence[DataFrame], key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left joins in turn; repeated right keys multiply rows, columns that clash get the suffixes."""
    for other in others:
        clash = [c for c in other.columns if c in base.columns and c != key]
        base = base.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        base = base.join(other.withColumnsRenamed({c: c + suffixes[1] for c in clash}), key, "left")
    return base


def lookup_merge(base: DataFrame, other: DataFrame, key: str, order: Column | str, defaults: Mapping[str, object], columns: Sequence[str] | None = None, base_order: Column | str | None = None) -> DataFrame:
    """A dictionary join: the last right row of each key, defaults where there is none.  With ``base_order``
    the left side is made unique in the same way."""
    left = keep_last(base, key, base_order) if base_order is not None else base
    keep = [c for c in (columns or other.columns) if c != key]
    joined = left.join(keep_last(other, key, order).select(key, *keep), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(defaults[c])) for c in keep if c in defaults})


def resolve_entities(rows: DataFrame, candidates: DataFrame, properties: DataFrame, row_id: str, cas: str, cid: str = "cid", key: str = "inchikey") -> DataFrame:
    """Adds ``status`` (no_cas, unresolved, ambiguous, resolved), ``cid`` and ``key``: a row resolves where
    all its candidates share one structure key, and then to the smallest candidate."""
    found = rows.filter(F.col(cas) != "").select(row_id, cas).join(candidates, cas).join(properties.select(cid, F.upper(key).alias(key)), cid).filter(F.col(key) != "")
    by_row = found.groupBy(row_id).agg(F.count_distinct(key).alias("_keys"), F.min_by(F.struct(cid, key), cid).alias("_best"))
    out = rows.join(by_row, row_id, "left")
    status = F.when(F.coalesce(F.col(cas), F.lit("")) == "", "no_cas").when(F.col("_keys").isNull(), "unresolved").when(F.col("_keys") > 1, "ambiguous").otherwise("resolved")
    one = F.col("_keys") == 1
    return out.withColumns({"status": status, cid: F.when(one, F.col(f"_best.{cid}")), key: F.when(one, F.col(f"_best.{key}"))}).drop("_keys", "_best")


def merge_conflicts(rows: DataFrame, key: str, order: str, labels: Sequence[str], joined: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """One row a key: each label's only known value, ``conflicts`` (names of labels with several), sorted
    distinct values of ``joined`` and those of the first member for ``first``."""
    aggs = [F.max(n).alias(n) for n in labels]
    aggs += [F.count_distinct(n).alias(f"_n_{n}") for n in labels]
    aggs += [F.concat_ws("; ", F.sort_array(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit(""))))).alias(c) for c in joined]
    aggs += [F.min_by(c, order).alias(c) for c in first]
    out = rows.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("n_members"))
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_n_{n}") > 1, n) for n in labels])), ",")
    return out.withColumn("conflicts", names).drop(*[f"_n_{n}" for n in labels])


def decontamination_status(rows: DataFrame, reference: DataFrame, key: str, prefix: int = 14) -> DataFrame:
    """Adds ``overlap``: exact, prefix (same first characters of a long enough key) or none.  Semi-joins on
    distinct reference keys; nothing is broadcast by force."""
    known = reference.select(F.upper(key).alias("_k")).filter(F.col("_k") != "").distinct()
    heads = known.filter(F.length("_k") >= prefix).select(F.substring("_k", 1, prefix).alias("_p")).distinct()
    keyed = rows.withColumns({"_u": F.upper(F.coalesce(F.col(key), F.lit(""))), "_h": F.when(F.length(F.col(key)) >= prefix, F.substring(F.upper(key), 1, prefix))})
    marked = keyed.join(known.withColumn("_exact", F.lit(True)), F.col("_u") == F.col("_k"), "left").join(heads.withColumn("_near", F.lit(True)), F.col("_h") == F.col("_p"), "left")
    status = F.when(F.col("_exact"), "exact").when(F.col("_near"), "prefix").otherwise("none")
    return marked.withColumn("overlap", status).drop("_u", "_h", "_k", "_p", "_exact", "_near")


def drop_exact(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    other = reference.select(F.upper(key).alias("_k")).distinct()
    return rows.join(other, F.upper(key) == F.col("_k"), "left_anti")


def drop_prefix(rows: DataFrame, reference: DataFrame, key: str, prefix: int = 14) -> DataFrame:
    other = reference.filter(F.length(key) >= prefix).select(F.substring(F.upper(key), 1, prefix).alias("_k")).distinct()
    return rows.join(other, (F.length(key) >= prefix) & (F.substring(F.upper(key), 1, prefix) == F.col("_k")), "left_anti")
