"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``prefix`` nearest pivots (reference vectors drawn from the
table). Inverted lists per (label, pivot) bring together vectors with a common pivot; a
pair becomes a candidate when it has ``shared`` pivots in common, and is then verified by
cosine in double precision.

Two prefixes that share ``shared`` pivots have a common one among the first
``prefix - shared + 1`` in pivot order, so only those are posted, and a pair is verified
only in the list of its smallest common pivot. A list is cut into blocks and each pair of
blocks is one group, so a hot list is many tasks. A group returns link counts per vector
and a spanning forest, never its pairs. Equal vectors are one class with a multiplicity.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_components, map_arrow, scratch_table
from .vectors import matrix, sample_vectors, usable

PIVOTS, PREFIX, SHARED, BLOCK = 128, 10, 3, 2048
# Rows that the pivots are chosen from; largest cosine of two pivots, seen from the rows' mean.
SAMPLE, APART = 2048, 0.6


def choose_pivots(sample: np.ndarray, n: int, apart: float = APART) -> tuple[np.ndarray, np.ndarray]:
    """(at most ``n`` of the sampled directions, in order, that lie apart from each other; the sample's mean direction).

    Directions are taken from the mean: a component that all vectors share would otherwise
    leave them all close to one pivot. Copies of one vector, however many the table has,
    give one pivot and cannot fill the prefixes of their neighbours.
    """
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    mean = unit.mean(0)
    off = unit - mean
    length = np.linalg.norm(off, axis=1)
    if length.max() < 1e-9:                     # one direction only
        return unit[:1], np.zeros_like(mean)
    off = off[length >= 1e-9] / length[length >= 1e-9][:, None]
    chosen: list[int] = []
    for k in range(len(off)):
        if len(chosen) == n:
            break
        if not chosen or (off[chosen] @ off[k]).max() < apart:
            chosen.append(k)
    return off[chosen], mean


def _described(batches: Iterable[pa.RecordBatch], pivots: np.ndarray, mean: np.ndarray, prefix: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if not part.num_rows:
            continue
        sizes = np.diff(np.asarray(part.column("vec").offsets))
        near = np.zeros((part.num_rows, min(prefix, len(pivots))), np.int32)
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            x = matrix(part.column("vec").take(pa.array(own)))
            d = min(n, pivots.shape[1])
            off = x[:, :d] / np.linalg.norm(x, axis=1)[:, None] - mean[:d]
            near[own] = np.sort(np.argsort(-(off @ pivots[:, :d].T), 1, "stable")[:, :near.shape[1]], 1)
        at = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
        yield part.append_column("near", pa.ListArray.from_arrays(at, pa.array(near.ravel())))


def _pair_blocks(table: pa.Table, threshold: float, shared: int, rows: int = 512) -> pa.Table:
    """(rep, weight, root): linked vectors of one block pair, the rows they link to, and a local root."""
    table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
    rep, count, side = (table.column(c).to_numpy() for c in ("rep", "n", "side"))
    pivot = table.column("pivot")[0].as_py()
    x = matrix(table.column("vec"))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = matrix(table.column("near")).astype(np.int64)
    words = near.max() // 64 + 1
    bits = np.zeros((len(rep), words), np.uint64)
    for k in range(near.shape[1]):
        bits[np.arange(len(rep)), near[:, k] // 64] |= np.uint64(1) << (near[:, k] % 64).astype(np.uint64)
    below = np.array([(1 << max(0, min(64, pivot - 64 * w))) - 1 for w in range(words)], np.uint64)
    split = int((side == 0).sum())
    both = split < len(rep)
    left, right = (np.arange(split), np.arange(split, len(rep))) if both else (np.arange(len(rep)),) * 2
    weight, a, b = np.zeros(len(rep), np.int64), [], []
    for at in range(0, len(left), rows):
        i = left[at:at + rows]
        j = right if both else right[at:]
        common = [bits[i, None, w] & bits[None, j, w] for w in range(words)]
        ok = sum(np.bitwise_count(c).astype(np.int16) for c in common) >= shared
        for w in range(words):
            ok &= (common[w] & below[w]) == 0
        if not both:
            ok &= i[:, None] < j[None, :]
        if not ok.any():
            continue
        ok &= x[i] @ x[j].T >= threshold
        u, v = np.nonzero(ok)
        u, v = i[u], j[v]
        weight += np.bincount(u, count[v], len(rep)).astype(np.int64) + np.bincount(v, count[u], len(rep)).astype(np.int64)
        a.append(u)
        b.append(v)
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
    root = local_components(len(rep), a, b) if len(a) else np.arange(len(rep))
    hit = weight > 0
    return pa.table({"rep": rep[hit], "weight": weight[hit], "root": rep[root[hit]]},
                    schema=pa.schema([("rep", pa.int64()), ("weight", pa.int64()), ("root", pa.int64())]))


def embedding_near_dups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                        label_col: str = "label", threshold: float = 0.98, pivots: int = PIVOTS, prefix: int = PREFIX,
                        shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Vectors link when their labels are equal and not null, they are equally long, and their
    cosine is at least ``threshold``. n_links counts the other rows linked directly;
    component_id is the smallest id reachable; kept marks the rows that are their own
    component. A vector that is null, zero, or has null or non-finite components, and one
    without a label or id, links with nothing (a row without an id: component null, kept).
    The pivots are at most ``pivots`` of ``SAMPLE`` rows chosen by a hash of the id; every row is indexed.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.transform(F.col(vec_col), lambda x: x.cast("float") + F.lit(0).cast("float")).alias("vec"))
    good = usable(F.col("vec")) & F.col("id").isNotNull() & F.col("label").isNotNull()
    classes = scratch_table(base.where(good).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")),
                            "vector-classes")
    points = sample_vectors(classes.select(F.col("rep").alias("id"), "vec"), max(SAMPLE, pivots))
    same = base.where(good).join(classes, ["label", "vec"]).select("id", "rep", "n")
    rest = base.where(~good).select("id", F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"))
    if not len(points):
        weights = classes.select("rep", F.lit(0).cast("long").alias("weight")).limit(0)
        comps = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    else:
        points, mean = choose_pivots(points, pivots)
        shared = min(shared, len(points))
        posted = min(prefix, len(points)) - shared + 1
        schema = "label string, vec array<float>, rep long, n long, near array<int>"
        described = scratch_table(map_arrow(classes, functools.partial(_described, pivots=points, mean=mean, prefix=prefix), schema),
                                  "vector-prefixes")
        key = ["label", "dim", "pivot"]
        posting = described.select("*", F.size("vec").alias("dim"),
                                   F.explode(F.slice("near", 1, posted)).alias("pivot"))
        blocks = posting.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        pairs = (posting.join(blocks, key).withColumn("own", own)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select(*key, F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"),
                         (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "n", "vec", "near"))
        found = scratch_table(
            pairs.groupBy(*key, "b0", "b1").applyInArrow(lambda t: _pair_blocks(t, threshold, shared),
                                                         "rep long, weight long, root long"), "vector-links")
        weights = found.groupBy("rep").agg(F.sum("weight").alias("weight"))
        comps = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "vector-components")
    linked = (same.join(weights, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
              .select("id", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    alone = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
