"""Shared handling of vector columns: which rows take part, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch


#: Sums of integers up to here are exact in doubles, whatever their order.
EXACT = 2.0**52


def floored(x: Column) -> Column:
    """The floor of a double as a double: floor() gives a long, which large ones don't fit; those have no fraction."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of n rows, by a hash of id and row; others are dropped where they are read."""
    share = min(1.0, (most + 4 * most**0.5) / max(n, 1))
    place = F.pmod(F.xxhash64("id", "row"), F.lit(1 << 31))
    return rows.where(place <= int(share * (1 << 31))).orderBy(place, "row").limit(most)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered vectors, in integers without bounds."""
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object) @ whole(b).astype(object).T


def to_long(scores: np.ndarray) -> np.ndarray:
    """Raises OverflowError where 64 bits don't suffice."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
        raise OverflowError("a score needs more than 64 bits; scale the vectors down")
    return np.array([int(s) for s in scores], np.int64)


def sound(df: DataFrame, vec_id: str, vector: str, zero: bool, scratch: Scratch, scaled=None, *more: Column) -> tuple[DataFrame, int]:
    """The rows that take part as a written table (row, id, vector, more), and the dimension. ``scaled``: what becomes of a vector.

    Vectors that are null, empty, hold null or non-finite components, are zero (unless ``zero``), and rows without an id take
    no part, nor do those of another length than the commonest one of the rest. ``row`` tells rows that share an id apart.
    """
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    good = v.isNotNull() & F.col(vec_id).isNotNull() & (F.size(v) > 0) & whole
    if not zero:
        good &= F.exists(v, lambda x: x != 0)
    numbered = df.where(good).select(F.col(vec_id).cast("long").alias("id"), (scaled(v) if scaled else v).alias("vector"), *more)
    rows = scratch.keep(numbered.select(F.monotonically_increasing_id().alias("row"), *numbered.columns))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = int(common["n"]) if common else 1
    return rows.where(F.size("vector") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Doubles, a row for each vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
