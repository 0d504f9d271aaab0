"""Nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Inner product becomes distance by one more component, sqrt(M^2 - |x|^2) with M the largest
norm (0 for queries). k-means centroids of a bounded sample give the lists; every row is
assigned to one. Vectors are rotated by a random orthogonal matrix, so the distance over
the first dimensions estimates the whole. A list is scanned in blocks of dimensions: after
each block a hypothesis test drops the candidates whose estimate lies significantly above
the query's current k-th distance; who survives all blocks is scored on the original
vectors. Lists and their queries are cut into blocks, so a hot list is many tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch_table
from .vectors import matrix, sample_vectors, usable

LISTS, PROBED, SAMPLE, CANDIDATES, QUERIES = 64, 0.75, 8192, 4096, 1024


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top**2 - (x * x).sum(1), 0))[:, None]], 1)


def fit_lists(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means centroids; at most one for each 32 sampled vectors."""
    k = max(1, min(lists, len(x) // 32))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def rotation(n: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


def _assigned(batches: Iterable[pa.RecordBatch], centre: np.ndarray, top: float, probes: int) -> Iterator[pa.RecordBatch]:
    """``lists``: the own list of a candidate, the probed lists of a query."""
    for part in batches:
        if not part.num_rows:
            continue
        x = matrix(part.column("vec"))
        query = part.column("query").to_numpy(zero_copy_only=False)
        x = np.where(query[:, None], np.concatenate([x, np.zeros((len(x), 1))], 1), _augmented(x, top))
        d = (centre * centre).sum(1) - 2 * x @ centre.T
        order = np.argsort(d, 1, "stable")
        lists = [order[k, :probes if query[k] else 1].astype(np.int32) for k in range(len(x))]
        yield part.append_column("lists", pa.array(lists, pa.list_(pa.int32())))


def adaptive_scan(q: np.ndarray, c: np.ndarray, k: int, step: int = 16, width: int = 512, strict: float = 2.1,
                  slack: float = 1e-9) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, candidate) pairs, all that may be among the k nearest of the rotated ``c``.

    The first 2 k candidates are scanned whole and set each query's k-th distance; all later
    ones are scanned ``step`` dimensions at a time, ``width`` candidates together. With d of D
    dimensions seen, a candidate whose partial distance times D / d exceeds the k-th
    distance by (1 + strict / sqrt(d))^2 is abandoned: under rotation a nearer one fails
    that test with vanishing probability. ``slack`` keeps ties.
    """
    dims = q.shape[1]
    blocks = [0, *range(2 * k, len(c), width)]
    cut = np.full(len(q), np.inf)
    nearest = np.full((len(q), k), np.inf)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at, end in zip(blocks, [*blocks[1:], len(c)]):
        part = c[at:end]
        if at == 0:
            d = (q * q).sum(1)[:, None] + (part * part).sum(1) - 2 * q @ part.T
            i, j = np.nonzero(d <= np.inf)
            value = d.ravel()
        else:
            d = np.zeros((len(q), len(part)))
            i = j = None
            for lo in range(0, dims, step):
                hi = min(dims, lo + step)
                test = cut * (hi / dims) * (1 + strict / np.sqrt(hi)) ** 2 if hi < dims else cut
                if i is None:
                    a, b = q[:, lo:hi], part[:, lo:hi]
                    d += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
                    alive = d <= (test + slack)[:, None]
                    if alive.mean() < 0.3 or hi == dims:
                        i, j = np.nonzero(alive)
                        value = d[i, j]
                else:
                    gap = q[i, lo:hi] - part[j, lo:hi]
                    value = value + np.einsum("ij,ij->i", gap, gap)
                    ok = value <= test[i] + slack
                    i, j, value = i[ok], j[ok], value[ok]
        kept.append((i, j + at, value))
        order = np.lexsort((value, i))
        i, value = i[order], value[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        near = rank < k
        new = np.full((len(q), k), np.inf)
        new[i[near], rank[near]] = value[near]
        nearest = np.sort(np.concatenate([nearest, new], 1), 1)[:, :k]
        cut = nearest[:, -1]
    for i, j, value in kept:
        ok = value <= cut[i] + slack
        yield i[ok], j[ok]


def _scan(table: pa.Table, k: int, top: float, turn: np.ndarray) -> pa.Table:
    table = table.sort_by([("query", "ascending"), ("id", "ascending")])
    ids = table.column("id").to_numpy()
    x = matrix(table.column("vec"))
    n = int((~table.column("query").to_numpy()).sum())
    cand, query = x[:n], x[n:]
    out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
    if n and len(query):
        rq = np.concatenate([query, np.zeros((len(query), 1))], 1) @ turn
        own = int(np.unique(ids[:n], return_counts=True)[1].max())  # rows of a query's own id may be among its nearest
        pairs = list(adaptive_scan(rq, _augmented(cand, top) @ turn, k + own))
        i, j = (np.concatenate(z) for z in zip(*pairs))
        other = ids[n:][i] != ids[:n][j]
        i, j = i[other], j[other]
        score = np.einsum("ij,ij->i", query[i], cand[j])
        order = np.lexsort((ids[:n][j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out = {"query_id": [ids[n:][i[best]]], "vec_id": [ids[:n][j[best]]], "score": [score[best]]}
    return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if c == "score" else pa.int64())
                     for c, v in out.items()})


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
                       lists: int = LISTS, probed: float = PROBED, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows, ties to the smaller id.

    ``is_query`` is a Column over ``vectors`` that marks the queries. The score is the inner
    product of the original vectors in double precision. Vectors that are null, zero or
    have null or non-finite components, and rows without an id, take no part; neither do vectors of
    another length than the most common one. The centroids come from at most ``sample`` rows chosen by a hash of the id;
    every row is in one list, and ``probed`` is the share of lists a query scans.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("query"))
    good = base.where(usable(F.col("vec")) & F.col("id").isNotNull())
    points = sample_vectors(good.select("id", "vec"), sample)
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(points):
        return vectors.sparkSession.createDataFrame([], empty)
    good = good.where(F.size("vec") == points.shape[1])
    squared = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = float(np.sqrt(good.agg(F.max(squared)).first()[0]))
    centre = fit_lists(_augmented(points, top), lists)
    probes = int(np.ceil(probed * len(centre)))
    both = good.where("query").unionByName(good.withColumn("query", F.lit(False)))
    kind = dict(base.dtypes)["vec"]
    assigned = scratch_table(map_arrow(both, functools.partial(_assigned, centre=centre, top=top, probes=probes),
                                       f"id long, vec {kind}, query boolean, lists array<int>"), "list-members")
    member = assigned.select("id", "vec", "query", F.explode("lists").alias("list"))
    size = member.groupBy("list").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("query")) / CANDIDATES)).cast("int").alias("c"),
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("query")) / QUERIES)).cast("int").alias("q"))
    member = member.join(F.broadcast(size), "list")  # one row per list, at most ``lists``
    own = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("q")).otherwise(F.col("c"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("c")).otherwise(F.col("q")) - 1))
    units = (member.withColumn("own", own).withColumn("other", other)
             .select("list", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("c"),
                     F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("q"), "id", "vec", "query"))
    turn = rotation(points.shape[1] + 1)
    found = units.groupBy("list", "c", "q").applyInArrow(lambda t: _scan(t, k, top, turn),
                                                         "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
