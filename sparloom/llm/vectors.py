"""What the operators on embedding columns share: usable rows, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector_col: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def dimensions(vectors: DataFrame, vector_col: str) -> tuple[int, int]:
    """Rows, and components of the longest vector."""
    said = vectors.agg(F.count(F.lit(1)), F.max(F.size(vector_col))).first()
    return int(said[0]), int(said[1] or 0)


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers without nulls as rows of doubles, shorter ones ended with zeros."""
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def floored(values: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as whole numbers; an error beyond ``most``, where sums of products wouldn't be exact."""
    out = np.floor(scale * values)
    if out.size and np.abs(out).max() > most:
        raise OverflowError(f"a component times {scale} is beyond {most}; scale the vectors first")
    return out.astype(np.int64)
