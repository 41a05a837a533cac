"""What the two vector operators share: which vectors take part, and matrices from record batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is not null, not all zero, and has no null, NaN or infinite component."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equally long lists of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def balanced(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two that brings their largest component to 0.5 to 1.

    Exact, so cosines stay what they are, and squares neither overflow nor vanish.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length."""
    x = balanced(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
