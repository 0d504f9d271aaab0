"""Vectors as Arrow columns: which of them count, and a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True where a vector is there, not zero, and every component is there and finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as the rows of a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def sample_vectors(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` of the vectors ``(id, vec)``, chosen by a hash of the id; all of the most common length."""
    lengths = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return np.zeros((0, 0))
    pick = vectors.where(F.size("vec") == lengths.n).orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "vec").toArrow()
    return matrix(pick.sort_by("id").column("vec"))
