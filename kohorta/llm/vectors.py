"""Vectors in tasks: which take part, blocks of them as matrices, and exact best lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<double>) of vectors that are not null, not empty, not all zero, without null or non-finite parts.

    Vectors of another length than the most frequent one (the greatest on ties) take no part either.
    """
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimension) of a column of lists of one length."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def rows_of(flat: bytes, n: int) -> np.ndarray:
    return np.frombuffer(flat, np.float64).reshape(n, -1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b at the same place; the order of the sum is the same for every pair."""
    return np.multiply(a, b).sum(axis=1)
