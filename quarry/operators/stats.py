"""Descriptive statistics, outlier limits, correlation, least squares; Box-Cox names from ``boxcox``.

Moments (mean, variance, correlation, regression sums) are partial/final aggregates.
Quantiles use ``order_stats`` (sketch brackets, two reads, exact) instead of ``percentile``,
whose final step keeps a counter per distinct value in one task.
Limits are one-row frames; ``scalar`` turns a limit into a scalar subquery, so a filter
on it stays one plan with no driver round trip and no cross join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_number_line
from .boxcox import boxcox_best, boxcox_fit, boxcox_grid, boxcox_profile, boxcox_transform  # noqa: F401
from .order_stats import exact_quantiles, summarise


def long_values(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(extra…, column_name, value) with values as double: one row per input cell."""
    return (df.select(*extra, *[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot(list(extra), list(cols), "column_name", "value"))


def central_tendency(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``df.mean()``, ``df.median()`` per column (and per ``extra`` group): (…, column_name, mean, median)."""
    keys = [*extra, "column_name"]
    return summarise(long_values(df, cols, extra), "value", {"median": 0.5}, keys).select(*keys, "mean", "median")


def dispersion(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Range (max − min), sample variance and standard deviation per column (ddof = 1)."""
    long = long_values(df, cols, extra)
    return long.groupBy(*extra, "column_name").agg(
        (F.max("value") - F.min("value")).alias("value_range"),
        F.var_samp("value").alias("variance"),
        F.stddev_samp("value").alias("std"))


def quantiles(df: DataFrame, col: str, probs: dict[str, float], group_cols: Sequence[str] = ()) -> DataFrame:
    """``s.quantile(p)`` for several p: exact, linearly interpolated, NULLs skipped."""
    return exact_quantiles(df, col, probs, group_cols)


def iqr(df: DataFrame, col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Quartiles and interquartile range: (q25, q75, iqr)."""
    q = exact_quantiles(df, col, {"q25": 0.25, "q75": 0.75}, group_cols)
    return q.withColumn("iqr", F.col("q75") - F.col("q25"))


def zscore_limits(df: DataFrame, col: str, k: float = 2.0) -> DataFrame:
    """mean ± k·std (sample): one row (lower_limit, upper_limit)."""
    m = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    return m.select((F.col("m") - k * F.col("s")).alias("lower_limit"),
                    (F.col("m") + k * F.col("s")).alias("upper_limit"))


def mean_iqr_limits(df: DataFrame, col: str, k: float = 2.0) -> DataFrame:
    """mean ± k·IQR, centred on the mean as in the reference (not Tukey's fences)."""
    mean = df.select(F.avg(col)).scalar()
    q = iqr(df, col)
    return q.select((mean - k * F.col("iqr")).alias("lower_limit"),
                    (mean + k * F.col("iqr")).alias("upper_limit"))


def limit(limits: DataFrame, name: str = "upper_limit") -> Column:
    """One limit of a one-row frame as a scalar-subquery Column."""
    return limits.select(name).scalar()


def format_limits(limits: DataFrame, decimals: int | None = None) -> DataFrame:
    """``"Upper Limit: {}".format(x)`` lines for both limits."""
    return limits.select(format_number_line("Upper Limit", "upper_limit", decimals).alias("upper_text"),
                         format_number_line("Lower Limit", "lower_limit", decimals).alias("lower_text"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df[cols].dropna().corr()`` in long form (var_a, var_b, corr), diagonal and both halves.

    One aggregate computes the Pearson correlation of every unordered pair.
    """
    cols = list(cols)
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop("any")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = clean.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], *[F.stddev_samp(c).alias(c) for c in cols])
    entries = []
    for a, b in pairs:
        v = F.col(f"`{a}|{b}`")
        entries += [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), v.alias("corr")),
                    F.struct(F.lit(b).alias("var_a"), F.lit(a).alias("var_b"), v.alias("corr"))]
    # The diagonal is 1 when the column varies (NaN when it is constant, as in pandas).
    for c in cols:
        one = F.when(F.col(c) > 0, F.lit(1.0)).otherwise(F.lit(float("nan")))
        entries.append(F.struct(F.lit(c).alias("var_a"), F.lit(c).alias("var_b"), one.alias("corr")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def least_squares(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of y on x (``regplot``): slope, intercept, r², n (complete pairs)."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


SQRT_2PI = math.sqrt(2 * math.pi)
