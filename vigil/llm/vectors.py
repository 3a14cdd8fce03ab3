"""Vectors of a table in the form the vector operators use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    x = F.col(c).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def dimension(df: DataFrame, c: str) -> int:
    """The most frequent number of components (0 for an empty table)."""
    got = df.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return got[0][0] if got else 0


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of ``dim`` components, in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
