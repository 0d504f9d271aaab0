"""Grouped exploration: revenue by dimension, peaks, totals, frequency tables.

All of these are ``groupBy().agg()`` plans: partial aggregation before the shuffle, so a
hot group costs one partial row per map task, not one task holding the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_, pct, period_range, text_eq_number


def revenue_by(df: DataFrame, dims: str | Sequence[str], amount: str = "sales",
               alias: str = "revenue", count_col: str | None = None, count_alias: str = "frequency") -> DataFrame:
    """``sum(amount) … group by dims order by revenue desc`` (+ ``count(count_col)``).

    The sum of a decimal is exact; it is returned as a double.
    """
    dims = [dims] if isinstance(dims, str) else list(dims)
    aggs = [F.sum(amount).cast("double").alias(alias)]
    if count_col:
        aggs.append(F.count(count_col).alias(count_alias))
    return df.groupBy(*dims).agg(*aggs).orderBy(F.desc(alias), *dims)


def revenue_in_period(df: DataFrame, year: str | int, month: str | int | None = None,
                      by: str = "month_id", amount: str = "sales", count_col: str = "ordernumber",
                      date_col: str | None = "orderdate") -> DataFrame:
    """Revenue and line count within a year (and month) per ``by``.

    Filters compare the text literal as a number (``year_id = ' 2004'``). With a month,
    the grouping is (month, by) and the month is not selected, as in the reference.
    ``date_col``: the same period as a range on the date column, which reaches the scan.
    """
    cond = period_filter(year, month, date_col)
    keys = ["month_id", by] if (month is not None and by != "month_id") else [by]
    out = revenue_by(df.where(cond), keys, amount=amount, count_col=count_col)
    return out.drop(*[k for k in keys if k != by])


def period_filter(year: str | int, month: str | int | None = None, date_col: str | None = "orderdate"):
    """``year_id = '<year>' [and month_id = '<month>']`` (text compared as number), plus the
    equivalent range on ``date_col`` so the predicate is pushed into the parquet scan."""
    y = int(str(year).strip())
    cond = text_eq_number("year_id", str(year))
    m = None
    if month is not None:
        m = int(str(month).strip())
        cond = cond & text_eq_number("month_id", str(month))
    if date_col:
        cond = cond & period_range(date_col, y, m)
    return cond


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of several categorical columns in one scan: (column_name, value).

    Combinations of the categories are made distinct first; only those are expanded.
    """
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).distinct()
    long = as_text.unpivot([], list(cols), "column_name", "value")
    return long.distinct()


def distinct_where(df: DataFrame, col: str, cond) -> DataFrame:
    return df.where(cond).select(col).distinct()


def peak_per_group(df: DataFrame, keys: Sequence[str], value, ratio_num=None, ratio_den=None,
                   value_alias: str = "peak", ratio_alias: str = "peak_pct") -> DataFrame:
    """``max(value)`` and ``max(a/b)*100`` per group (A5). Cast text before calling."""
    aggs = [F.max(col_(value)).alias(value_alias)]
    if ratio_num is not None:
        aggs.append(F.max(pct(col_(ratio_num).cast("double"), col_(ratio_den).cast("double"))).alias(ratio_alias))
    return df.groupBy(*keys).agg(*aggs)


def rows_at_group_max(df: DataFrame, keys: Sequence[str], value) -> DataFrame:
    """Rows whose ``value`` equals the maximum of their group (correlated subquery J4).

    Expressed as the aggregate joined back on the group key and the value: the same plan
    Catalyst makes of the correlated form. Groups whose values are all NULL drop out.
    """
    v = col_(value)
    tagged = df.withColumn("_v", v)
    peaks = tagged.groupBy(*keys).agg(F.max("_v").alias("_v"))
    return tagged.join(peaks, [*keys, "_v"]).drop("_v")


def lines_per_key(df: DataFrame, key: str, cond=None, alias: str = "n_lines") -> DataFrame:
    """``select key, count(*) … [where cond] group by key``."""
    src = df.where(cond) if cond is not None else df
    return src.groupBy(key).agg(F.count(F.lit(1)).alias(alias))


def value_counts(df: DataFrame, col: str, top: int | None = None, alias: str = "n") -> DataFrame:
    """``s.value_counts()``: NULL excluded, most frequent first (ties by value)."""
    out = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(alias))
    out = out.orderBy(F.desc(alias), F.asc(col))
    return out.limit(top) if top else out


def ranked_group_means(df: DataFrame, key: str, value: str, min_count: int = 10,
                       exclude: str | None = None, ascending: bool = False) -> DataFrame:
    """Group mean + non-null count, keep groups with count ≥ min_count, ranked by mean.

    ``exclude`` drops one key value (``!=`` also drops NULL keys, as pandas' groupby does).
    """
    src = df.where(F.col(key) != exclude) if exclude is not None else df.where(F.col(key).isNotNull())
    out = (src.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
              .where(F.col("count") >= min_count))
    return out.orderBy(F.asc("mean") if ascending else F.desc("mean"), key)


def grouped_totals(df: DataFrame, keys: Sequence[str], sums: dict[str, object], ratio: tuple | None = None):
    """Totals (``sum``) per group, or over everything when ``keys`` is empty, plus a ratio."""
    aggs = [F.sum(col_(expr)).alias(alias) for alias, expr in sums.items()]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if ratio:
        alias, num, den = ratio
        out = out.withColumn(alias, pct(F.col(num).cast("double"), F.col(den).cast("double")))
    return out


def best_by_dimension(df: DataFrame, dims: dict, amount: str = "sales") -> DataFrame:
    """For each named dimension, the value with the highest total of ``amount``.

    ``dims`` maps a name to a Column (NULL where the row does not count for it, e.g. outside
    a period). One scan: rows are totalled over all dimensions together, that small table is
    expanded once per dimension, then the best value per dimension is the maximum of
    (total, value) — ties go to the larger value, deterministically.
    (dimension, best_value, revenue)
    """
    base = df.groupBy(*[col_(c).cast("string").alias(n) for n, c in dims.items()]).agg(F.sum(amount).alias("_amt"))
    long = base.unpivot(["_amt"], list(dims), "dimension", "value").where(F.col("value").isNotNull())
    totals = long.groupBy("dimension", "value").agg(F.sum("_amt").cast("double").alias("revenue"))
    best = totals.groupBy("dimension").agg(F.max(F.struct("revenue", "value")).alias("_b"))
    return best.select("dimension", F.col("_b.value").alias("best_value"), F.col("_b.revenue").alias("revenue"))
