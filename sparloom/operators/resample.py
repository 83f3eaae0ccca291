"""Bootstrap intervals and paired deltas.

A replicate is n draws with replacement.  Its counts of each row come from hashed draw numbers, so a result
depends on seed and rows alone.  Rows are reduced to sufficient statistics first (per label tp, fp, fn;
wrong cells; exact match), drawn rows are counted by replicate and statistics, and summed: everything is a
distributed aggregate, whatever n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.lineage import numbered
from sparloom.functions.text import hashed_int
from sparloom.operators.gates import GateError
from sparloom.operators.metrics import ratio
from sparloom.session import ship

METRICS = ("subset_accuracy", "micro_f1", "macro_f1", "hamming_loss")


#: Rows that may be broadcast with their statistics: some 50 MB.
MAX_BROADCAST_ROWS = 500_000


def draws(spark, replicates: int, n: int, seed) -> DataFrame:
    """(b, idx): n drawn row numbers for each replicate."""
    cells = spark.range(replicates * n).select(F.floor(F.col("id") / F.lit(n)).cast("int").alias("b"), F.pmod(F.col("id"), F.lit(n)).alias("j"))
    return cells.select("b", F.pmod(hashed_int(seed, F.col("b"), F.col("j")), F.lit(n)).alias("idx"))


def row_statistics(wide: DataFrame, id_col: str, labels: Sequence[str], truth, pred, prefix: str = "") -> DataFrame:
    """One row an id: tp, fp, fn of each label, wrong cells, exact match.  ``truth`` and ``pred`` map a label to a Column."""
    out: dict[str, Column] = {}
    for n in labels:
        t, p = truth(n) == 1, pred(n) == 1
        out |= {f"{prefix}tp_{n}": (t & p).cast("int"), f"{prefix}fp_{n}": (~t & p).cast("int"), f"{prefix}fn_{n}": (t & ~p).cast("int")}
    wrong = sum((out[f"{prefix}{k}_{n}"] for n in labels for k in ("fp", "fn")), F.lit(0))
    out |= {f"{prefix}wrong": wrong, f"{prefix}exact": (wrong == 0).cast("int")}
    return wide.select(id_col, *[c.alias(k) for k, c in out.items()])


def _metrics(labels: Sequence[str], weight: Column, prefix: str = "", rows: Column | None = None) -> list[Column]:
    rows = F.sum(weight) if rows is None else rows
    total = lambda k: F.sum(weight * F.col(f"{prefix}{k}"))
    f1 = [ratio(2 * total(f"tp_{n}"), 2 * total(f"tp_{n}") + total(f"fp_{n}") + total(f"fn_{n}")) for n in labels]
    tp, fp, fn = (sum((total(f"{k}_{n}") for n in labels[1:]), total(f"{k}_{labels[0]}")) for k in ("tp", "fp", "fn"))
    values = {"subset_accuracy": ratio(total("exact"), rows), "micro_f1": ratio(2 * tp, 2 * tp + fp + fn), "macro_f1": sum(f1[1:], f1[0]) / F.lit(float(len(f1))), "hamming_loss": ratio(total("wrong"), rows * len(labels))}
    return [values[m].alias(f"{prefix}{m}") for m in METRICS]


def replicates_of(stats: DataFrame, id_col: str, labels: Sequence[str], replicates: int, seed, prefixes: Sequence[str] = ("",), by_class: bool = False) -> DataFrame:
    """(b, metrics): one row a replicate.

    Statistics take few values, so drawn rows are counted by their values where they are drawn (the statistics
    are broadcast while they are few) and only these counts are shuffled.  ``by_class`` draws the counts
    themselves, for any number of rows: as many multinomial draws as there are replicates, over classes of rows
    with equal statistics.  It is the same estimator with other random numbers.
    """
    kinds = [c for c in stats.columns if c != id_col]
    n = stats.count()
    if not n:
        raise GateError("nothing to draw from")
    if by_class:
        return _class_replicates(stats, kinds, labels, replicates, n, seed, prefixes)
    rows = numbered(stats, [F.col(id_col)], "idx").drop(id_col)
    drawn = draws(stats.sparkSession, replicates, n, seed).join(F.broadcast(rows) if n <= MAX_BROADCAST_ROWS else rows, "idx")
    counted = drawn.groupBy("b", *kinds).agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy("b").agg(*[m for p in prefixes for m in _metrics(labels, F.col("times"), p)])


#: Classes of rows that one task draws from: some 10 MB with nine labels and two systems.
CLASSES_PER_BLOCK = 50_000


def _class_replicates(stats: DataFrame, kinds: Sequence[str], labels: Sequence[str], replicates: int, n: int, seed, prefixes: Sequence[str]) -> DataFrame:
    """Multinomial draws over classes of rows with equal statistics, in blocks of classes: how many of a replicate's n
    rows fall into each block is drawn first, alike in every task, then each block's rows over its own classes.  So
    there may be any number of classes."""
    spark = stats.sparkSession
    classes = numbered(stats.groupBy(*kinds).agg(F.count(F.lit(1)).alias("size")), [F.col(k) for k in kinds], "place").withColumn("_block", F.floor(F.col("place") / CLASSES_PER_BLOCK).cast("int"))
    sizes = [r["n"] for r in classes.groupBy("_block").agg(F.sum("size").alias("n")).orderBy("_block").collect()]  # a number a block
    of_blocks = np.array(sizes, np.float64) / n
    hash_seed = int.from_bytes(hashlib.md5(str(seed).encode()).digest()[:4], "big")
    schema = "b int, drawn long, " + ", ".join(f"`{k}` long" for k in kinds)

    def draw(key, rows):
        block = int(key[0])
        rows = rows.sort_values("place")
        values, shares = rows[list(kinds)].to_numpy(np.int64), rows["size"].to_numpy(np.float64) / rows["size"].sum()
        out = np.empty((replicates, 2 + len(kinds)), np.int64)
        for b in range(replicates):
            count = int(np.random.default_rng([hash_seed, b]).multinomial(n, of_blocks)[block])
            out[b, :2] = b, count
            out[b, 2:] = np.random.default_rng([hash_seed, b, block]).multinomial(count, shares) @ values
        return pd.DataFrame(out, columns=["b", "drawn", *kinds])

    ship(spark)
    sums = classes.groupBy("_block").applyInPandas(draw, schema)
    return sums.groupBy("b").agg(*[m for p in prefixes for m in _metrics(labels, F.lit(1), p, F.sum("drawn"))])


def require_one_truth(stats: DataFrame, labels: Sequence[str], a: str = "a_", b: str = "b_") -> None:
    """Both systems must have been judged against the same truth: a row whose positives differ is an error."""
    differs = F.lit(False)
    for n in labels:
        differs |= F.col(f"{a}tp_{n}") + F.col(f"{a}fn_{n}") != F.col(f"{b}tp_{n}") + F.col(f"{b}fn_{n}")
    bad = stats.agg(F.count_if(F.coalesce(differs, F.lit(True)))).first()[0]
    if bad:
        raise GateError(f"{bad} rows have another truth in one system than in the other")


def bootstrap_ci(stats: DataFrame, id_col: str, labels: Sequence[str], replicates: int = 10_000, seed=123, alpha: float = 0.05, by_class: bool = True) -> DataFrame:
    """(metric, value, mean, ci95_low, ci95_high): exact percentiles with linear interpolation; the names
    are ci95 whatever alpha is."""
    point = stats.agg(*_metrics(labels, F.lit(1))).unpivot([], list(METRICS), "metric", "value")
    long = replicates_of(stats, id_col, labels, replicates, seed, by_class=by_class).unpivot(["b"], list(METRICS), "metric", "v")
    spread = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", alpha / 2).alias("ci95_low"), F.percentile("v", 1 - alpha / 2).alias("ci95_high"))
    return point.join(spread, "metric").select("metric", "value", "mean", "ci95_low", "ci95_high")


def paired_bootstrap(stats: DataFrame, id_col: str, labels: Sequence[str], replicates: int = 10_000, seed=123, alpha: float = 0.05, by_class: bool = True) -> DataFrame:
    """Deltas of system b over a, both drawn alike (columns prefixed ``a_`` and ``b_``): point, interval, share
    of replicates at or below 0, and share in which b isn't better (lower is better for the Hamming loss).  Rows with
    different truths in the two systems are an error."""
    require_one_truth(stats, labels)
    both = [F.col(f"b_{m}") - F.col(f"a_{m}") for m in METRICS]
    point = stats.agg(*_metrics(labels, F.lit(1), "a_"), *_metrics(labels, F.lit(1), "b_")).select(*[d.alias(m) for d, m in zip(both, METRICS, strict=True)]).unpivot([], list(METRICS), "metric", "delta")
    drawn = replicates_of(stats, id_col, labels, replicates, seed, ("a_", "b_"), by_class).select("b", *[d.alias(m) for d, m in zip(both, METRICS, strict=True)]).unpivot(["b"], list(METRICS), "metric", "d")
    worse = F.when(F.col("metric") == "hamming_loss", F.col("d") >= 0).otherwise(F.col("d") <= 0)
    spread = drawn.groupBy("metric").agg(
        F.percentile("d", alpha / 2).alias("ci95_low"), F.percentile("d", 1 - alpha / 2).alias("ci95_high"), F.avg((F.col("d") <= 0).cast("double")).alias("p_delta_le_0"), F.avg(worse.cast("double")).alias("p_not_better")
    )
    return point.join(spread, "metric").select("metric", "delta", "ci95_low", "ci95_high", "p_delta_le_0", "p_not_better")
