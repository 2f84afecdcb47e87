"""Helpers for columns of vectors: which rows are whole, matrices of them, and exact sums of whole numbers of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 32
SUMS = "part int, dim int, limb int, value long"


def finite(column: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.col(column)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as a matrix of their own kind of number, shorter rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width), flat.dtype)
    starts = np.cumsum(n) - n
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(starts, n)] = flat
    return out


class ExactSums:
    """Sums of rows of whole numbers by part, exact whatever their size."""

    def __init__(self, parts: int, width: int):
        self.sums = np.zeros((parts, width), object)

    def add(self, part: int, rows: np.ndarray) -> None:
        if len(rows):
            small = rows.dtype != object and len(rows) * int(np.abs(rows).max(initial=0)) < 1 << 62
            self.sums[part] += (rows if small else rows.astype(object)).sum(0)

    def batch(self) -> pa.RecordBatch:
        """The sums in limbs of 32 bits, which Spark adds up as longs; the highest limb has the sign."""
        rows = []
        for (part, dim), value in np.ndenumerate(self.sums):
            value, limb = int(value), 0
            while value:
                last = -(1 << 31) <= value < 1 << 31
                rows.append((part, dim, limb, value if last else value & ((1 << LIMB) - 1)))
                value, limb = 0 if last else value >> LIMB, limb + 1
        part, dim, limb, value = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(dim, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["part", "dim", "limb", "value"])


def total(limbs: DataFrame) -> dict[tuple[int, int], int]:
    """The exact sums by part and dimension, added up by Spark; what comes back depends on neither rows nor tasks."""
    out: dict[tuple[int, int], int] = {}
    for r in limbs.groupBy("part", "dim", "limb").agg(F.sum("value").alias("value")).collect():
        out[r.part, r.dim] = out.get((r.part, r.dim), 0) + (r.value << LIMB * r.limb)
    return out
