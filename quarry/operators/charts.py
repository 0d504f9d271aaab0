"""The numbers behind the reference's charts (G1–G14), as small DataFrames.

A chart of a huge column is drawn from a bounded summary: bins, grid points or buckets.
Range statistics (min, max, n, std) of all columns a chart needs come from ONE partial/
final aggregate whose single row is read back as parameters (a bounded, one-row
result); the per-row bin and kernel expressions then use plain literals, which keeps them
inside whole-stage codegen. Per-bin and per-grid tables have ``k`` or ``gridsize`` rows,
so windows over them are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import exact_quantiles, summarise
from .stats import long_values


class Range(NamedTuple):
    lo: float | None
    hi: float | None
    n: int
    std: float | None


def range_params(df: DataFrame, cols: Sequence[str]) -> dict[str, Range]:
    """min, max, non-null count and sample std of each column, from one aggregate job."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"n{i}"),
                 F.stddev_samp(x).alias(f"sd{i}")]
    row = df.agg(*aggs).first()
    return {c: Range(row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"], row[f"sd{i}"]) for i, c in enumerate(cols)}


def _edges(lo: float, hi: float) -> tuple[float, float]:
    # numpy: a constant column gets the range (v − 0.5, v + 0.5)
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def equal_width_bin(x: Column, lo: float | None, hi: float | None, k: int) -> Column:
    """Bin index in [0, k) of k equal-width bins over [lo, hi]; the last bin is closed.

    The index is corrected against the edges lo + i·width, so a value lying on an edge
    goes to the bin that edge opens (numpy's rule). NULL for a NULL value, and when the
    column has no values.
    """
    if lo is None:
        return F.lit(None).cast("int")
    lo_e, hi_e = _edges(lo, hi)
    L, H = F.lit(lo_e), F.lit(hi_e)
    width = (H - L) / k
    raw = F.floor((x - L) * (F.lit(float(k)) / (H - L)))
    b0 = F.least(F.greatest(raw, F.lit(0)), F.lit(k - 1))
    down = x < L + b0 * width
    up = (x >= L + (b0 + 1) * width) & (b0 != k - 1)
    # greatest() skips NULLs, so a NULL value needs its own branch
    return F.when(x.isNotNull(), F.when(down, b0 - 1).when(up, b0 + 1).otherwise(b0)).cast("int")


def fd_bins(df: DataFrame, col: str, most: int) -> int:
    """Default bin count of a distribution plot: Freedman–Diaconis bins, ``most`` at most.

    ``most`` is part of the chart (distribution plots draw no more than 50 bars); every row
    is counted whatever the number of bins.

    Width 2·IQR·n^(−1/3) over the range; √n bins when the IQR is 0; 1 bin below 2 values.
    Count, range and quartiles are one summary, whose single row is read back.
    """
    st = summarise(df, col, {"q25": 0.25, "q75": 0.75}).first()
    if st["n"] < 2:
        return 1
    h = 2 * (st["q75"] - st["q25"]) / (st["n"] ** (1 / 3))
    k = int(math.sqrt(st["n"])) if h == 0 else int(math.ceil((st["max"] - st["min"]) / h))
    return min(k, most)


def histogram(df: DataFrame, col: str, k: int, density: bool = False) -> DataFrame:
    """``.plot(kind='hist', bins=k)``: (bin, lo, hi, n[, density]) for all k bins.

    Empty bins are kept by a right join onto the spine 0..k−1 (k rows).
    """
    st = range_params(df, [col])[col]
    x = F.col(col).cast("double")
    counts = (df.where(x.isNotNull())
                .groupBy(equal_width_bin(x, st.lo, st.hi, k).alias("bin"))
                .agg(F.count(F.lit(1)).alias("n")))
    spine = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    lo_e, hi_e = _edges(st.lo, st.hi) if st.lo is not None else (None, None)
    L, H = F.lit(lo_e).cast("double"), F.lit(hi_e).cast("double")
    width = (H - L) / k
    out = (spine.join(F.broadcast(counts), "bin", "left")      # counts has at most k rows
                .select("bin", (L + F.col("bin") * width).alias("lo"),
                        (L + (F.col("bin") + 1) * width).alias("hi"),
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    if density:
        out = out.withColumn("density", F.col("n") / (F.lit(st.n) * width))
    return out


def ecdf(df: DataFrame, col: str, k: int) -> DataFrame:
    """Cumulative histogram: (bin, hi, n, cum_n, cum_share) over k bins."""
    h = histogram(df, col, k)
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # k rows
    total = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return h.select("bin", "hi", "n", F.sum("n").over(w).alias("cum_n"),
                    (F.sum("n").over(w) / F.sum("n").over(total)).alias("cum_share"))


def rug(df: DataFrame, col: str) -> DataFrame:
    """Observed values as (value, n): one row per distinct value."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# Boxes of the density estimate: width in bandwidths, and terms of the series in each.
_BOX, _TERMS = 0.25, 12


def _hermite(n: int) -> list[list[float]]:
    """Monomial coefficients of the probabilists' Hermite polynomials He_0 … He_(n-1)."""
    rows = [[1.0], [0.0, 1.0]]
    for k in range(1, n - 1):
        low = rows[k - 1] + [0.0, 0.0]
        rows.append([a - k * b for a, b in zip([0.0, *rows[k]], low)])
    return rows[:n]


def kde(df: DataFrame, col: str, gridsize: int = 200, cut: float = 0.0, bw_adjust: float = 1.0,
        pad_range: float = 0.0) -> DataFrame:
    """Gaussian kernel density on a grid: (grid_index, x, density).

    Bandwidth = sample std · n^(−1/5) · bw_adjust (Scott's rule). The grid spans
    [min − cut·bw − pad·range, max + cut·bw + pad·range] in ``gridsize`` points:
    seaborn's ``kdeplot(cut=0)`` is gridsize=200, cut=0; pandas' ``plot(kind='kde')`` is
    gridsize=1000, pad_range=0.5.

    One partial aggregate reduces the values to power moments Σt^k of boxes a quarter of a
    bandwidth wide (t: distance from the box's middle in bandwidths, |t| ≤ 1/8); only boxes
    meet the grid. With u the grid point's distance from the middle, a kernel is
    exp(−(u−t)²/2) = exp(−u²/2) · Σ_k He_k(u) t^k / k!, cut after 12 terms. As
    |He_k(u)| exp(−u²/2) ≤ 1.09 √k!, the rest is below 1.09 · Σ_(k≥12) 8^(−k) / √k! < 1e-15
    of a kernel's peak per value. There are range / bw · 4 boxes, whatever the row count.
    """
    st = range_params(df, [col])[col]
    sd = F.lit(st.std).cast("double")
    bw = sd * F.pow(F.lit(float(st.n)), F.lit(-0.2)) * F.lit(bw_adjust)
    mn, mx = F.lit(st.lo).cast("double"), F.lit(st.hi).cast("double")
    lo = mn - F.lit(cut) * bw - F.lit(pad_range) * (mx - mn)
    hi = mx + F.lit(cut) * bw + F.lit(pad_range) * (mx - mn)
    step = (hi - lo) / F.lit(gridsize - 1)
    x = F.col(col).cast("double")
    curve = _box_density(df.where(x.isNotNull()).select(x.alias("v")), [], mn, bw, lo, step, gridsize)
    return curve.select("grid_index", "x", (F.col("mass") / F.lit(st.n)).alias("density"))


def _box_density(values: DataFrame, keys: Sequence[str], mn: Column, bw: Column, lo: Column, step: Column,
                 gridsize: int) -> DataFrame:
    """(keys…, grid_index, x, mass): kernel sums of ``v`` over the bandwidth, by box moments as ``kde`` says.

    ``mn``, ``bw``, ``lo`` and ``step`` are literals, or columns of ``values`` that the keys determine.
    """
    keys = list(keys)
    params = {"p_mn": mn, "p_bw": bw, "p_lo": lo, "p_step": step}
    boxes = [*keys, *params, "box"] if keys else ["box"]
    placed = values.withColumns(params) if keys else values
    mn, bw, lo, step = (F.col(p) for p in params) if keys else params.values()
    middle = mn + (F.col("box") + 0.5) * (bw * _BOX)
    placed = placed.withColumn("box", F.floor((F.col("v") - mn) / (bw * _BOX)))
    placed = placed.withColumn("t", (F.col("v") - middle) / bw)
    power, moments = F.lit(1.0), [F.count(F.lit(1)).cast("double").alias("m0")]
    for k in range(1, _TERMS):
        power = power * F.col("t")
        moments.append(F.sum(power).alias(f"m{k}"))
    summary = placed.groupBy(*boxes).agg(*moments)
    # the series as one polynomial in u per box
    he = _hermite(_TERMS)
    coefs = []
    for i in range(_TERMS):
        c = F.lit(0.0)
        for k in range(i, _TERMS):
            if he[k][i]:
                c = c + F.col(f"m{k}") * (he[k][i] / math.factorial(k))
        coefs.append(c.alias(f"c{i}"))
    summary = summary.select(*boxes[:-1], middle.alias("middle"), *coefs)
    pts = summary.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))))
    gx = lo + F.col("grid_index") * step
    pts = pts.withColumn("u", (gx - F.col("middle")) / bw)
    series = F.col(f"c{_TERMS - 1}")
    for i in reversed(range(_TERMS - 1)):
        series = series * F.col("u") + F.col(f"c{i}")
    dens = pts.groupBy(*boxes[:-1], "grid_index").agg(F.sum(F.exp(F.lit(-0.5) * F.col("u") * F.col("u")) * series).alias("_s"))
    return dens.select(*keys, "grid_index", gx.alias("x"),
                       (F.col("_s") / (bw * F.lit(math.sqrt(2 * math.pi)))).alias("mass"))


def group_density(values: DataFrame, value: str, within: Sequence[str], group: str, gridsize: int = 200, cut: float = 3.0,
                  bw_adjust: float = 1.0, common_norm: bool = True) -> DataFrame:
    """Density curve of each group: (within…, group, grid_index, x, density).

    The diagonal of ``pairplot(hue=…)``: every group has its own Scott bandwidth and its own
    grid from min − cut·bw to max + cut·bw. With ``common_norm`` the curves of one ``within``
    together hold an area of 1 (each its share of the values), otherwise each holds 1. Rows whose
    value or key is NULL take no part; groups of one value, or of equal values, have no curve.

    Counts, ranges and deviations of all groups are one aggregate; the values meet that table by a
    join on the keys (broadcast if it is measured as small, else split where a key is hot) and
    are reduced to box moments per group before anything else is shuffled. No group's numbers
    pass through the driver.
    """
    keys = [*within, group]
    rows = values.select(*keys, F.col(value).cast("double").alias("v")).na.drop("any")
    per = rows.groupBy(*keys).agg(F.min("v").alias("g_lo"), F.max("v").alias("g_hi"), F.count("v").alias("g_n"),
                                  F.stddev_samp("v").alias("g_sd"))
    whole = Window.partitionBy(*[F.col(c) for c in within])            # one row per group
    share = F.col("g_n") / F.sum("g_n").over(whole) if common_norm else F.lit(1.0)
    per = per.withColumn("g_share", share).where("g_hi > g_lo")
    bw = F.col("g_sd") * F.pow(F.col("g_n").cast("double"), F.lit(-0.2)) * F.lit(bw_adjust)
    lo = F.col("g_lo") - F.lit(cut) * bw
    per = per.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], "g_lo", "g_n", "g_share", bw.alias("g_bw"),
                     lo.alias("g_from"), ((F.col("g_hi") + F.lit(cut) * bw - lo) / F.lit(gridsize - 1)).alias("g_step"))
    on = [F.col(c) == F.col(f"k{i}") for i, c in enumerate(keys)]
    curve = _box_density(rows.join(per, on), [*keys, "g_n", "g_share"], F.col("g_lo"), F.col("g_bw"), F.col("g_from"),
                         F.col("g_step"), gridsize)
    return curve.select(*keys, "grid_index", "x", (F.col("mass") * F.col("g_share") / F.col("g_n")).alias("density"))


def cumulative_density(curve: DataFrame) -> DataFrame:
    """Running sum of a ``kde`` curve over its grid, as a share of the whole: (grid_index, x, cum_density)."""
    so_far = Window.orderBy("grid_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # gridsize rows
    whole = Window.orderBy("grid_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return curve.select("grid_index", "x", (F.sum("density").over(so_far) / F.sum("density").over(whole)).alias("cum_density"))


def joint_marginals(df: DataFrame, x: str, y: str, k: int = 10) -> DataFrame:
    """Histograms of both columns over the complete (x, y) rows: (column_name, bin, lo, hi, n)."""
    pairs = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return (histogram(pairs, x, k).select(F.lit(x).alias("column_name"), "*")
            .unionByName(histogram(pairs, y, k).select(F.lit(y).alias("column_name"), "*")))


def joint_bins(df: DataFrame, x: str, y: str, k: int = 10, hue: str | None = None) -> DataFrame:
    """2-D binned counts of complete (x, y) rows: ([hue,] bin_x, bin_y, n), non-empty cells.

    Bins span each column's range over the complete rows (what a joint/scatter plot shows).
    """
    keep = [c for c in (hue, x, y) if c]
    pairs = df.select(*keep).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    p = range_params(pairs, [x, y])
    sx, sy = p[x], p[y]
    bx = equal_width_bin(F.col(x).cast("double"), sx.lo, sx.hi, k).alias("bin_x")
    by = equal_width_bin(F.col(y).cast("double"), sy.lo, sy.hi, k).alias("bin_y")
    keys = ([F.col(hue)] if hue else []) + [bx, by]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def pair_grid(df: DataFrame, cols: Sequence[str], hue: str, k: int = 10) -> DataFrame:
    """``pairplot(vars, hue)``: binned counts for every ordered pair (diagonal included).

    (var_x, var_y, hue, bin_x, bin_y, n). Each variable is binned over its own range;
    each row then yields one entry per unordered pair of its non-null variables (a bounded
    expansion), aggregated with partial aggregation; the small result is mirrored.
    """
    cols = list(cols)
    p = range_params(df, cols)
    binned = df.select(F.col(hue).alias("hue"), *[
        equal_width_bin(F.col(c).cast("double"), p[c].lo, p[c].hi, k).alias(c) for c in cols])
    entries = F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                                 F.col(a).alias("bin_x"), F.col(b).alias("bin_y"))
                        for i, a in enumerate(cols) for b in cols[i:]])
    long = binned.select("hue", F.explode(entries).alias("e")).select("hue", "e.*")
    half = (long.where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
                .groupBy("var_x", "var_y", "hue", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))
    # the other half is the mirror image of the counts
    mirror = F.struct(F.col("var_y").alias("var_x"), F.col("var_x").alias("var_y"),
                      F.col("bin_y").alias("bin_x"), F.col("bin_x").alias("bin_y"))
    same = F.struct("var_x", "var_y", "bin_x", "bin_y")
    both = F.when(F.col("var_x") == F.col("var_y"), F.array(same)).otherwise(F.array(same, mirror))
    return half.select("hue", "n", F.explode(both).alias("e")).select("e.var_x", "e.var_y", "hue", "e.bin_x", "e.bin_y", "n")


def _with_fences(df: DataFrame, cols: Sequence[str], whis: float, extra: Sequence[str] = ()) -> DataFrame:
    """Each value in long form with its column's quartiles and the fences whis·IQR beyond them."""
    long = long_values(df, cols, extra).where(F.col("value").isNotNull())
    q = exact_quantiles(long_values(df, cols), "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column_name"]) \
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    return (long.join(F.broadcast(q), "column_name")          # one row per column
                .withColumn("_low", F.col("q1") - whis * F.col("iqr"))
                .withColumn("_high", F.col("q3") + whis * F.col("iqr")))


def box_stats(df: DataFrame, cols: Sequence[str], whis: float = 1.5) -> DataFrame:
    """``boxplot``: per column q1, median, q3, iqr, whiskers and outlier count.

    Whiskers are the most extreme values within whis·IQR of the quartiles.
    """
    v = F.col("value")
    return _with_fences(df, cols, whis).groupBy("column_name", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(v >= F.col("_low"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_high"), v)).alias("whisker_high"),
        F.count_if((v < F.col("_low")) | (v > F.col("_high"))).alias("n_outliers"))


def box_outliers(df: DataFrame, cols: Sequence[str], key: str, whis: float = 1.5) -> DataFrame:
    """The points a box plot draws outside the whiskers: (column_name, key, value)."""
    v = F.col("value")
    return (_with_fences(df, cols, whis, [key]).where((v < F.col("_low")) | (v > F.col("_high")))
            .select("column_name", key, "value"))


def series_buckets(df: DataFrame, ts: str, cols: str | Sequence[str], every: str = "1 day") -> DataFrame:
    """Line charts of one or more series reduced to time buckets:
    (column_name, bucket_start, n, min, max, mean), one aggregate pass for all series."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    long = (df.select(F.window(ts, every).start.alias("bucket_start"), *[F.col(c).cast("double") for c in cols])
              .unpivot(["bucket_start"], cols, "column_name", "value"))
    return (long.groupBy("column_name", "bucket_start")
                .agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
                     F.avg("value").alias("mean")))
