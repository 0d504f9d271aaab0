"""Resampling without rows × replicates (R5, G9): Poisson bootstrap by vector accumulators.

Each row's Poisson(1) weight in each replicate comes from md5 of (row key, block, seed), four
weights a digest, so a recomputed partition repeats them and SQL can too. Spark computes the
digests of a row as one binary value; a task turns its rows' digests into a weight matrix,
batch by batch, and adds its product with the statistics' columns to one accumulator of
(replicates × columns) sums. Tasks send these sums only; no row is ever expanded.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson1_cdf(kmax: int = 20) -> list[float]:
    """P(X ≤ k) of Poisson(1) for k = 0 … kmax; what is left beyond is below the digests' resolution."""
    return list(itertools.accumulate(math.exp(-1.0) / math.factorial(k) for k in range(kmax + 1)))


def _row_digests(key: Column, replicates: int, seed: int) -> Column:
    """The md5 digests of (key, block, seed) for all blocks of four replicates, one after another."""
    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // 4))
    each = F.transform(blocks, lambda b: F.md5(F.concat_ws("|", key.cast("string"), b.cast("string"), F.lit(str(seed))).cast("binary")))
    return F.unhex(F.array_join(each, ""))


def _accumulate(names: list[str], replicates: int):
    cdf = poisson1_cdf()

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        edges, total = np.array(cdf), np.zeros((replicates, len(names) + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                digests = b"".join(part.column("digests").to_pylist())
                u = np.frombuffer(digests, ">u4").reshape(part.num_rows, -1)[:, :replicates] / 4294967296.0
                weights = np.searchsorted(edges, u, "right").astype(np.float64)      # the smallest k with u < P(X <= k)
                columns = np.column_stack([np.ones(part.num_rows), *(part.column(c).to_numpy() for c in names)])
                total += weights.T @ columns
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1), pa.int32()),
                                          *(pa.array(total[:, i]) for i in range(len(names) + 1))], ["replicate", "w", *names])
    return run


def replicate_sums(df: DataFrame, key: str, columns: dict[str, Column], replicates: int = 100, seed: int = 7,
                   partitions: int | None = None) -> DataFrame:
    """Weighted sums of ``columns`` in every replicate: (replicate, w, one column per entry).

    ``w`` is the sum of the weights. Rows with a NULL among the columns do not count.
    ``partitions`` deals the rows out first, for inputs of fewer files than the cluster has cores.
    """
    names = list(columns)
    rows = df.select(F.col(key).alias("_key"), *[c.cast("double").alias(n) for n, c in columns.items()]).na.drop(subset=names)
    rows = rows.repartition(partitions) if partitions else rows
    rows = rows.select(_row_digests(F.col("_key"), replicates, seed).alias("digests"), *names)
    schema = ", ".join(["replicate int", "w double", *[f"`{n}` double" for n in names]])
    return (rows.mapInArrow(_accumulate(names, replicates), schema).groupBy("replicate")
            .agg(F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in names]))


def _interval(statistic: str, per_replicate: DataFrame, estimate: Column, alpha: float) -> DataFrame:
    ends = per_replicate.agg(F.percentile("value", alpha / 2).alias("ci_low"), F.percentile("value", 1 - alpha / 2).alias("ci_high"),
                             F.count(F.lit(1)).alias("replicates"))
    return ends.select(F.lit(statistic).alias("statistic"), estimate.alias("estimate"), "ci_low", "ci_high", "replicates")


def bootstrap_ci(df: DataFrame, value: str, key: str, replicates: int = 100, seed: int = 7, alpha: float = 0.05,
                 partitions: int | None = None) -> DataFrame:
    """Percentile interval of the mean of ``value`` over the replicates' means, one row:
    (statistic, estimate, ci_low, ci_high, replicates)."""
    sums = replicate_sums(df, key, {"v": F.col(value)}, replicates, seed, partitions)
    estimate = df.select(F.avg(F.col(value).cast("double"))).scalar()
    return _interval(f"mean({value})", sums.select((F.col("v") / F.col("w")).alias("value")), estimate, alpha)


def _pair_columns(x: str, y: str) -> dict[str, Column]:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return {"x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}


def bootstrap_corr_ci(df: DataFrame, x: str, y: str, key: str, replicates: int = 100, seed: int = 7, alpha: float = 0.05,
                      partitions: int | None = None) -> DataFrame:
    """Percentile interval of the Pearson correlation of the complete (x, y) rows, like ``bootstrap_ci``."""
    sums = replicate_sums(df, key, _pair_columns(x, y), replicates, seed, partitions)
    mean = {c: F.col(c) / F.col("w") for c in ("x", "y", "xx", "yy", "xy")}
    r = (mean["xy"] - mean["x"] * mean["y"]) / F.sqrt((mean["xx"] - mean["x"] ** 2) * (mean["yy"] - mean["y"] ** 2))
    estimate = df.select(F.corr(F.col(x).cast("double"), F.col(y).cast("double"))).scalar()
    return _interval(f"corr({x},{y})", sums.select(r.alias("value")), estimate, alpha)


def regression_band(df: DataFrame, y: str, x: str, key: str, points: int = 100, replicates: int = 100, seed: int = 7,
                    alpha: float = 0.05, partitions: int | None = None) -> DataFrame:
    """The least-squares line of y on x with its resampled band on a grid over x's range:
    (grid_index, x, fitted, lower, upper).

    The band is, at each grid point, the percentile interval of the replicates' lines. Only
    the replicates' sums (one row each) meet the grid. Complete pairs count.
    """
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    whole = df.where(xd.isNotNull() & yd.isNotNull()).agg(
        F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept"), F.min(xd).alias("lo"), F.max(xd).alias("hi"))
    sums = replicate_sums(df, key, _pair_columns(x, y), replicates, seed, partitions)
    mean = {c: F.col(c) / F.col("w") for c in ("x", "y", "xx", "xy")}
    slope = F.try_divide(mean["xy"] - mean["x"] * mean["y"], mean["xx"] - mean["x"] ** 2)
    lines = sums.select(F.lit(1).alias("one"), slope.alias("b"), mean["x"].alias("mx"), mean["y"].alias("my"))
    grid = (whole.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("at", F.col("lo") + F.col("grid_index") * ((F.col("hi") - F.col("lo")) / (points - 1))))
    # the lines of all replicates as one array (a pair of numbers each), read at every grid point
    row = lines.agg(F.collect_list(F.struct("b", "mx", "my")).alias("lines")).scalar()
    fits = F.array_sort(F.transform("lines", lambda r: r["my"] + r["b"] * (F.col("at") - r["mx"])))

    def quantile(p: float) -> Column:
        h = (F.size("fits") - 1) * F.lit(p)
        lo = F.get("fits", F.floor(h).cast("int"))
        return lo + (F.get("fits", F.ceil(h).cast("int")) - lo) * (h - F.floor(h))
    return (grid.withColumn("lines", row).withColumn("fits", fits).select(
        "grid_index", F.col("at").alias("x"), (F.col("intercept") + F.col("slope") * F.col("at")).alias("fitted"),
        quantile(alpha / 2).alias("lower"), quantile(1 - alpha / 2).alias("upper")))
