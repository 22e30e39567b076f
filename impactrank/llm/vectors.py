"""Vector columns: which rows take part, and Arrow lists as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, below: float) -> Column:
    """Whether a vector is there, and so are all its components, each a number of less than ``below`` in size."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < below))


def widest(vectors: DataFrame, column: str = "vector") -> int:
    """The largest length of a vector; 0 if there are none."""
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A row a vector, in double precision; shorter vectors are filled with zeros at their end."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out
