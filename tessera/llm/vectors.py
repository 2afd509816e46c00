"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components saturate at this magnitude, far beyond any embedding's.
MOST = 1 << 40


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole_vectors(table: DataFrame, scale: int, vector_col: str = "embedding", multiple_of: int = 1) -> DataFrame:
    """The usable rows of table with `ints`: floor(scale * x) of each component as double. Shorter vectors are filled up with zeros to the length of the
    longest, rounded up to a multiple of multiple_of."""
    rows = table.withColumn("ints", F.col(vector_col).cast("array<double>")).filter(F.coalesce(usable(F.col("ints")), F.lit(False)))
    least, most = rows.agg(F.min(F.size("ints")), F.max(F.size("ints"))).first()
    ints = F.transform("ints", lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x * scale))).cast("bigint"))
    length = -(-max(most or 0, 1) // multiple_of) * multiple_of
    return rows.withColumn("ints", ints if least == length else F.concat(ints, F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size("ints"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of vectors of one length as int64[row, component]."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices, pair by pair. Where 64 bits might not hold them they are taken of Python's numbers and saturate."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    return np.clip((a.astype(object) * b.astype(object)).sum(1), -(2**63), 2**63 - 1).astype(np.int64)
