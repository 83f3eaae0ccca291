"""Embedding whitening by a one-sided Jacobi SVD (operator 13).

Blockwise TSQR: every task reduces its centred rows to a triangular factor R, batch by batch; the factors are
stacked and reduced in groups until few are left, and the last one, of as many rows as there are dimensions, goes
to the driver.  Plane rotations then make R's columns orthogonal; their lengths are the standard deviations (times
the root of the number of rows) and the accumulated rotations the components.  Small deviations come out as
accurate as large ones, since the covariance is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import keeping_nothing, ship
from sparloom.llm.vectors import dimensions, floored, matrix, usable

#: Triangular factors that meet in one task, and that may reach the driver.
FAN_IN = 64
#: Whole numbers beyond this aren't taken, so that sums stay within 64 bits.
MOST = 1 << 40
BATCH = 4096


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(V, sigma): the columns of r V are orthogonal and have the lengths sigma, the longest first.

    One-sided plane rotations, all disjoint pairs of columns at once, in rounds as of a tournament.
    """
    d = r.shape[1]
    a, v = np.array(r, np.float64), np.eye(d)
    if d % 2:
        a, v = np.pad(a, ((0, 0), (0, 1))), np.pad(v, ((0, 0), (0, 1)))
    players = np.arange(a.shape[1])
    tiny = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            p, q = players[:half], players[half:][::-1]
            players = np.concatenate((players[:1], players[-1:], players[1:-1]))
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > tiny * np.sqrt(xx) * np.sqrt(yy)
            if not turn.any():
                continue
            turned = True
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))[:d]
    order = np.argsort(-sigma, kind="stable")
    return v[:, :d][:, order], sigma[order]


class Whitening(NamedTuple):
    """A fit: rows and sums of the whole numbers, components (a column each), their deviations, shares of variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray


def _blocks(batches: Iterable[pa.RecordBatch], column: int, width: int, scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, floored(matrix(part.column(column), width), scale, MOST) + shift


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n times the distance to the mean, in whole numbers."""
    return x * n - np.array(sums, np.int64)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _summed(vectors: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None], kind: str) -> list:
    """Sums over all rows of the numbers that each task gives, by place: a list of as many as a task gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (x := make(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.size)), pa.array(x.ravel())], names=["place", "v"])

    parts = vectors.mapInArrow(keeping_nothing(run), f"place long, v {kind}")
    return [r[0] for r in parts.groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").select("v").collect()]


def fit(vectors: DataFrame, vector_col: str, scale: int, shift: int, most: int) -> Whitening | None:
    """The whitening of all rows of ``vectors`` (usable ones only); None where there is none."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(vector_col)
    n, width = dimensions(vectors, vector_col)
    if not n or not width:
        return None

    def add(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        sums = [x.sum(0) for _, x in _blocks(batches, 0, width, scale, shift)]
        return np.sum(sums, axis=0) if sums else None

    sums = [int(s) for s in _summed(vectors, add, "long")]

    def reduce_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _blocks(batches, 0, width, scale, shift):
            y = _centred(x, n, sums) / n
            r = _triangle(y if r is None else np.vstack((r, y)))
        yield from _as_row(r)

    def reduce_factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part = np.frombuffer(data).reshape(-1, width)
                r = part if r is None else _triangle(np.vstack((r, part)))
        yield from _as_row(r)

    parts = vectors.rdd.getNumPartitions()
    factors = vectors.mapInArrow(keeping_nothing(reduce_rows), "r binary")
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        factors = factors.repartition(parts, F.spark_partition_id()).mapInArrow(keeping_nothing(reduce_factors), "r binary")
    stacked = np.vstack([np.frombuffer(row[0]).reshape(-1, width) for row in factors.collect()])  # at most FAN_IN factors
    v, sigma = jacobi(_triangle(stacked))
    variance = sigma**2 / n
    real = (sigma > sigma[0] * width * np.finfo(np.float64).eps) & (sigma > 0)
    k = int(min(most, real.sum()))
    total = variance.sum()
    return Whitening(n, sums, v[:, :k], np.sqrt(variance[:k]), variance[:k] / total if total else variance[:k])


def _as_row(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])


def _whitened(y: np.ndarray, said: Whitening) -> np.ndarray:
    return (y / said.n) @ said.components / said.deviations


def identity_error(vectors: DataFrame, vector_col: str, scale: int, shift: int, said: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, measured over all rows."""
    width, k = len(said.sums), len(said.deviations)

    def moments(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in _blocks(batches, 0, width, scale, shift):
            w = _whitened(_centred(x, said.n, said.sums), said)
            part = np.vstack((w.sum(0), w.T @ w))
            total = part if total is None else total + part
        return total

    found = np.array(_summed(vectors.select(vector_col), moments, "double")).reshape(k + 1, k)
    mean = found[0] / said.n
    return float(np.abs(found[1:] / said.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 32) -> DataFrame:
    """One row per usable row and component: id, ``component`` (from 1, the largest variance first), ``n``,
    ``deviation`` (sum over dimensions of (n x - S)^2, exact; null beyond 64 bits), ``whitened``, ``explained`` and
    ``identity_error``.  Entries c count as x = floor(scale * c) + shift; the fit is over all usable rows.

    Rows whose vector is null or holds null or non-finite entries are left out; entries that a shorter vector lacks
    are zeros; null and repeated ids give rows like any other.  There are as many components as have any variance,
    ``components`` at most: none, and so no row, in an empty table or one of equal vectors.  Further columns are
    ignored, whatever their names.  Entries beyond 2^40 after scaling are an error.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.filter(usable(vector_col)).select(F.col(id_col), F.col(vector_col))
    said = fit(rows, vector_col, scale, shift, components)
    if said is None or not len(said.deviations):
        return spark.createDataFrame([], schema)
    error = identity_error(rows, vector_col, scale, shift, said)
    width, k = len(said.sums), len(said.deviations)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, width, scale, shift):
            y = _centred(x, said.n, said.sums)
            m = len(y)
            keys = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            numbers = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, said.n)]
            rest = [_whitened(y, said).ravel(), np.tile(said.explained, m), np.full(m * k, error)]
            deviation = pa.array(_squares(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, numbers), deviation, *map(pa.array, rest)], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(keeping_nothing(run), schema)


def _squares(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None where it has over 63 bits."""
    near = (y.astype(np.float64) ** 2).sum(1)
    sums = (y * y).sum(1).tolist()
    for i in np.flatnonzero(near > 9.2e18).tolist():
        exact = sum(int(v) ** 2 for v in y[i])
        sums[i] = exact if exact < 1 << 63 else None
    return sums
