"""Integer vectors: what the operators on embeddings read, and Arrow columns of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long, or null for a vector that takes no part.

    Those are null, or hold null, NaN or a component that isn't finite once scaled. Integers beyond 64 bits are held at
    the ends of that range.
    """
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) == F.lit(float("inf"))))
    return F.when(~odd, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


def padded(df: DataFrame, dims: int) -> DataFrame:
    """Column x with zeros behind shorter vectors, so that all have ``dims`` components."""
    return df.withColumn("x", F.when(F.size("x") < dims, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))).otherwise(F.col("x")))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of lists of ``dims`` integers as rows of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, dims)


def exact(x: np.ndarray, within: bool) -> np.ndarray:
    """x for exact arithmetic: itself where results stay within 64 bits, else as Python integers."""
    return x if within else x.astype(object)


def held(values: np.ndarray) -> np.ndarray:
    """Integers as int64, those beyond it at the ends of its range."""
    return values if values.dtype == np.int64 else np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in values], dtype=np.int64)
