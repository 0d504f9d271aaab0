"""Embedding whitening: exact sums, a distributed covariance, mixed-precision eigenvectors.

Entries become whole numbers, so counts, sums and deviations from the mean are exact. The
covariance of the distinct vectors is a sum of per-task products of centred rows. Its
eigenvectors are computed in float32 first and then corrected by the matrix-multiplication
iteration of Ogita and Aishima in extended precision; eigenvalues that lie too close
together for the correction are separated by solving the small problem of their cluster.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, scratch_table

_EDGE = float(1 << 52)          # scaled entries are held within these limits


class Components(NamedTuple):
    """Unit eigenvectors (columns) by falling eigenvalue."""
    values: np.ndarray
    vectors: np.ndarray


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of eigenvalues (in order) whose neighbours are at most ``gap`` apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return np.split(order, cuts)


def _sub_solve(a: np.ndarray, x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The columns ``group`` of ``x``, orthonormal and turned to the eigenvectors of ``a`` in their span."""
    y = x[:, group].copy()
    for k in range(y.shape[1]):                 # Gram-Schmidt, twice, in the precision of x
        for _ in range(2):
            y[:, k] -= y[:, :k] @ (y[:, :k].T @ y[:, k])
        y[:, k] /= np.sqrt(y[:, k] @ y[:, k])
    small = y.T @ (a @ y)
    shift = np.trace(small) / len(group)
    small = small - shift * np.eye(len(group), dtype=small.dtype)
    scale = np.abs(small).max()
    if not scale:
        return y
    _, turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))
    return y @ turn.astype(y.dtype)


def refined_eigenvectors(matrix: np.ndarray, start: np.ndarray | None = None, rounds: int = 12) -> Components:
    """Eigenvectors of a symmetric float64 matrix, from float32 ones (or ``start``).

    A round computes R = I - X'X and S = X'AX in extended precision, reads the eigenvalues
    from their diagonals and corrects X by X E, with E_ij = (S_ij + l_j R_ij) / (l_j - l_i)
    where the eigenvalues lie in different clusters, and R_ij / 2 inside one. A cluster holds
    eigenvalues closer than the error of S, or than what division by their distance would
    amplify; it is turned by a sub-solve first. Convergence is quadratic.
    """
    wide = np.longdouble
    n = len(matrix)
    largest = np.abs(matrix).max() if n else 0.0
    if not largest:
        return Components(np.zeros(n), np.eye(n))
    a = matrix.astype(wide) / wide(largest)
    x = (np.linalg.eigh((matrix / largest).astype(np.float32))[1] if start is None else start).astype(wide)
    eye, values = np.eye(n, dtype=wide), np.zeros(n, wide)
    norm = float(np.linalg.norm(matrix / largest, 2))
    tiny = n * float(np.finfo(np.float64).eps)
    near = float(np.sqrt(np.finfo(np.float64).eps)) * norm
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        error = 2 * (np.linalg.norm((s - np.diag(values)).astype(float), 2) + norm * np.linalg.norm(r.astype(float), 2))
        apart_enough = np.ones((n, n), bool)
        for group in _clusters(values, max(error, near)):
            apart_enough[np.ix_(group, group)] = False
            if len(group) > 1:
                x[:, group] = _sub_solve(a, x, group)
        r, s = eye - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        apart = values[None, :] - values[:, None]
        e = np.where(apart_enough, (s + values[None, :] * r) / np.where(apart_enough, apart, 1), r / 2)
        x = x + x @ e
        if np.abs(e).max() < tiny:
            break
    x = x + x @ ((eye - x.T @ x) / 2)           # what the division by small gaps left
    r, s = eye - x.T @ x, x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    vectors = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return Components((values[order] * wide(largest)).astype(float), vectors.astype(float))


def whole_entries(vec, scale: float, shift: int):
    """floor(scale * entry) + shift of each entry, held within 2**52, or null for a vector that does not count."""
    fine = vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c):
        scaled = F.floor(F.greatest(F.lit(-_EDGE), F.least(F.lit(_EDGE), c.cast("double") * F.lit(float(scale)))))
        return scaled.cast("long") + F.lit(shift).cast("long")
    return F.when(fine, F.transform(vec, whole))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _sum_task(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * width
        for batch in batches:
            x = _rows(batch.column("x"), width)
            count += len(x)
            # halves keep each partial sum within 64 bits whatever the entries
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in [count, *total]])], ["at", "total"])
    return run


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S as exact whole numbers: in 64 bits where they fit, else Python's."""
    most = max([abs(t) for t in total] + [n * (int(np.abs(x).max()) if x.size else 0)])
    if most < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _product_task(width: int, n: int, total: list[int], turn: np.ndarray | None):
    """The task's sum of products of centred rows, turned by ``turn`` first if there is one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = None, False
        for batch in batches:
            if batch.num_rows:
                c = (_centred(_rows(batch.column("x"), width), n, total) / n).astype(np.float64)
                c = c if turn is None else c @ turn
                out, seen = c.T @ c + (out if seen else 0.0), True
        if seen:
            flat = out.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "total"])
    return run


def _mean_product(fit: DataFrame, width: int, n: int, total: list[int], turn: np.ndarray | None = None) -> np.ndarray:
    size = width if turn is None else turn.shape[1]
    sums = map_arrow(fit, _product_task(width, n, total, turn), "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    out = np.zeros(size * size)
    for r in sums.collect():                    # one row per pair of dimensions
        out[r["at"]] = r["total"]
    out = out.reshape(size, size) / n
    return (out + out.T) / 2


def _whiten_task(width: int, n: int, total: list[int], turn: np.ndarray, positive: np.ndarray, explained: np.ndarray, error: float):
    count = turn.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                rows = piece.num_rows
                d = _centred(_rows(piece.column("x"), width), n, total)
                top = int(np.abs(d).max()) if d.size else 0
                if width * top * top < 1 << 63:
                    deviation = pa.array((d * d).sum(axis=1), pa.int64())
                else:
                    exact = [sum(int(v) ** 2 for v in row) for row in d.tolist()]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                y = (d / n).astype(np.float64) @ turn
                every = np.repeat(np.arange(rows), count)
                yield pa.RecordBatch.from_arrays([
                    piece.column("id").take(pa.array(every)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, n)), deviation.take(pa.array(every)),
                    pa.array(y.reshape(-1), mask=~np.tile(positive, rows)), pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * count, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


_OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each vector's whitened coordinates: (id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or hold null or non-finite entries are left out, and so are those
    whose length is not the most common one (of equally common lengths the smallest counts).
    Entries become x = floor(scale * entry) + shift, held within 2**52. The distinct x-vectors
    are the fit list: its size is ``n``, its sums S; ``deviation`` is the exact sum of
    (n x - S)**2, null where it does not fit a long. A component whose eigenvalue is not
    above rounding has null ``whitened`` (as with a single distinct vector); identity_error
    is over the others. Rows that repeat an id or a vector are rows of their own; a null id
    stays null; an empty table gives an empty result. Bounded: counts and sums (a row per
    dimension), the covariance and the components (dimensions squared) come to the driver.
    """
    spark = vectors.sparkSession
    table = vectors.select(F.col(id_col).cast("long").alias("id"), whole_entries(F.col(vec_col), scale, shift).alias("x"))
    table = table.where(F.col("x").isNotNull())
    common = table.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None or not common.width:
        return spark.createDataFrame([], _OUT)
    width = common.width
    table = table.where(F.size("x") == width)
    fit = scratch_table(table.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct-vectors")
    sums = {r["at"]: int(r["total"]) for r in
            map_arrow(fit, _sum_task(width), "at int, total string").groupBy("at")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n, total = sums[-1], [sums[k] for k in range(width)]
    covariance = _mean_product(fit, width, n, total)
    found = refined_eigenvectors(covariance)
    count = min(components, width)
    values, trace = found.values[:count], float(np.trace(covariance))
    positive = values > max(found.values[0], 0.0) * width * np.finfo(float).eps
    turn = found.vectors[:, :count] / np.sqrt(np.where(positive, values, 1.0))
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(count)
    white = _mean_product(fit, width, n, total, turn)[np.ix_(positive, positive)]
    error = float(np.abs(white - np.eye(len(white))).max()) if len(white) else 0.0
    return map_arrow(table, _whiten_task(width, n, total, turn, positive, explained, error), _OUT)
