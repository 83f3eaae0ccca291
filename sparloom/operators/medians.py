"""Exact medians of many columns: selection by counted digits, all columns in the same passes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.session import ship

#: Bits of a digit: six passes over 64-bit keys, and 2,048 counts for each value that is looked for.
BITS = 11
_LEVELS = tuple(range(55, -1, -BITS))


def keys_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; both zeros are one."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def value_of(key: int) -> float:
    signed = np.array([key], np.uint64) ^ np.uint64(1 << 63)
    bits = signed.view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The median of each column, the mean of the two middle values where there are two; nulls and NaN are left out,
    None where nothing is left.

    Each pass counts the rows of every column by one digit under the prefix found so far, so no column is sorted or
    gathered; a row for each value that is looked for reaches the driver.
    """
    ship(df.sparkSession)
    columns = list(columns)
    if not columns:
        return {}
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    some = lambda i: F.col(f"c{i}").isNotNull() & ~F.isnan(f"c{i}")
    sizes = list(data.agg(*[F.count_if(some(i)).alias(f"n{i}") for i in range(len(columns))]).first())
    # (column, place from 0) of the values that are looked for
    wanted = sorted({(i, at) for i, n in enumerate(sizes) if n for at in ((n - 1) // 2, n // 2)})
    prefix, left = [0] * len(wanted), [at for _, at in wanted]
    for level in _LEVELS if wanted else ():
        found = _digits(data, [i for i, _ in wanted], prefix, level)
        order = Window.partitionBy("t").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        ranks = df.sparkSession.createDataFrame(list(enumerate(left)), "t int, rank long")
        below = found.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0))).join(F.broadcast(ranks), "t")
        for r in below.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))).collect():
            prefix[r["t"]] = prefix[r["t"]] << BITS | r["d"]
            left[r["t"]] = r["rank"] - r["below"]
    values = {w: value_of(p) for w, p in zip(wanted, prefix, strict=True)}
    return {c: (values[i, (n - 1) // 2] + values[i, n // 2]) / 2 if n else None for i, (c, n) in enumerate(zip(columns, sizes, strict=True))}


def _digits(data: DataFrame, of: list[int], prefix: list[int], level: int) -> DataFrame:
    """(t, d, n): for each value looked for, its column's rows under its prefix by the next digit."""
    above = level + BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(of), 1 << BITS), np.int64)
        for batch in batches:
            for i in sorted(set(of)):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                keys = keys_of(x[~np.isnan(x)])
                for t in (t for t, c in enumerate(of) if c == i):
                    here = keys if above >= 64 else keys[keys >> np.uint64(above) == np.uint64(prefix[t])]
                    total[t] += np.bincount((here >> np.uint64(level)).astype(np.int64) & ((1 << BITS) - 1), minlength=1 << BITS)
        t, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(d, pa.int32()), pa.array(total[t, d])], names=["t", "d", "n"])

    return data.mapInArrow(count, "t int, d int, n long").groupBy("t", "d").agg(F.sum("n").alias("n"))
