"""Integrity gates: each counts what is wrong in one aggregate and raises, or hands the counts back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.text import is_strict_binary


class GateError(ValueError):
    pass


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n): repeated keys, and null ones."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())


def require_unique(df: DataFrame, key: str, what: str = "id") -> DataFrame:
    """No null or repeated keys; at most five examples reach the driver."""
    bad = duplicates(df, key).limit(5).collect()
    if bad:
        raise GateError(f"duplicate or missing {what}: {[r[0] for r in bad]}")
    return df


def id_mismatch(left: DataFrame, right: DataFrame, key: str) -> dict[str, int]:
    """Keys only on the left and only on the right."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    r = a.join(b, key, "full_outer").agg(F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_l").isNull()).alias("extra")).first()
    return {"missing": r["missing"], "extra": r["extra"]}


def require_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    found = id_mismatch(left, right, key)
    if any(found.values()):
        raise GateError(f"ids differ: {found}")


def require_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(~is_strict_binary(F.col(c))).alias(c) for c in columns]).first().asDict()
    if any(counts.values()):
        raise GateError(f"values that aren't binary: { {k: v for k, v in counts.items() if v} }")
    return df


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _tie(df: DataFrame) -> Column:
    """What tells equal orders apart: the whole row; as JSON where it has maps, which have no order."""
    return F.to_json(_row(df)) if any("map<" in t for _, t in df.dtypes) else _row(df)


def _order(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def keep_last(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last row of each key, by a partial aggregate rather than a window.  Rows without an order come
    first, and of equal ones the largest row is the last.  A null key is a key."""
    rank = F.struct(_order(order).isNotNull(), _order(order), _tie(df))
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(_row(df), rank).alias("_r")).select("_r.*")


def keep_first(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The first row of each key.  Rows without an order come last; of equal ones the smallest row is
    the first."""
    rank = F.struct(_order(order).isNull(), _order(order), _tie(df))
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(_row(df), rank).alias("_r")).select("_r.*")


def with_row_ids(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """``df`` with the row's place from 0, in the given order, as the key of rows that have none."""
    from sparloom.functions.lineage import numbered

    placed = numbered(df, [_order(order)], "_place")
    own = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
    return placed.withColumn(key, F.coalesce(own, F.col("_place").cast("string"))).drop("_place")


def align_strict(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Inner join of tables whose keys are unique and equal."""
    require_unique(gold, key)
    require_unique(pred, key)
    require_same_ids(gold, pred, key)
    return gold.join(pred, key)


def align_gold(gold: DataFrame, pred: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Every gold key needs a prediction; further predictions go, the last of repeated ones holds."""
    missing = gold.select(key).join(pred.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise GateError(f"predictions are missing for {[r[0] for r in missing]}")
    return keep_last(gold, key, order).join(keep_last(pred, key, order), key)


def align_matched(gold: DataFrame, pred: DataFrame, key: str) -> tuple[DataFrame, dict[str, int]]:
    return gold.join(pred, key), id_mismatch(gold, pred, key)


def zip_by_position(left: DataFrame, right: DataFrame, position: str, key: str | None = None) -> DataFrame:
    """Rows paired by an explicit position; lengths must agree, and ids too where the right side has them."""
    require_unique(left, position)
    require_unique(right, position)
    require_same_ids(left, right, position)
    if key and key in right.columns:
        other = right.withColumnRenamed(key, "_id")
        joined = left.join(other, position)
        clash = (F.trim(F.coalesce(F.col("_id").cast("string"), F.lit(""))) != "") & (F.col("_id").cast("string") != F.col(key).cast("string"))
        if joined.filter(clash).limit(1).count():
            raise GateError("ids differ at the same position")
        return joined.drop("_id")
    return left.join(right, position)


def select_in_order(df: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``ids`` (key, order) in that order; a key that isn't there is an error."""
    missing = ids.select(key).join(df.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise GateError(f"not found: {[r[0] for r in missing]}")
    return ids.join(df, key).orderBy(order)


def require_same_gold(a: DataFrame, b: DataFrame, id_col: str, truth: str = "truth", label: str = "label") -> None:
    """Two long gold tables must have the same cells with the same values."""
    x, y = a.select(id_col, label, F.col(truth).alias("_a")), b.select(id_col, label, F.col(truth).alias("_b"))
    wrong = x.join(y, [id_col, label], "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).limit(5).collect()
    if wrong:
        raise GateError(f"gold differs: {[(r[0], r[1]) for r in wrong]}")


def require_complete(df: DataFrame, status: str = "parse_status", complete: tuple[str, ...] = ("ok", "regex_recovered")) -> DataFrame:
    """All rows have one of the complete statuses; the counts of the others are in the error."""
    bad = df.groupBy(status).agg(F.count(F.lit(1)).alias("n")).filter(~F.coalesce(F.col(status).isin(*complete), F.lit(False))).collect()  # a row a status
    if bad:
        raise GateError(f"incomplete answers: { {r[0]: r['n'] for r in bad} }")
    return df
