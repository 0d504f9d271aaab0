"""Cleaning: date slices, dropping keys or masked rows, back-fill, outlier removal.

Back-fill is the one ordered operator here. ``first(x, ignorenulls) over (order by ts
rows between current row and unbounded following)`` with no partition key sends the
whole table through one task; ``backfill`` instead works on balanced contiguous ranges
of the order (``rank.ordered_buckets``): fill inside each range with a per-range window,
then carry the first valid value of the next non-empty range into the trailing gaps of
each range from a table with one row per range.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col_
from .rank import BUCKET, POS, ordered_buckets


def date_slice(df: DataFrame, ts: str, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """``df.loc['a':'b']`` on a time column: both ends inclusive by whole day.

    ``ts >= a and ts < b + 1 day`` (``between(a, b)`` would lose the last day's rows after
    midnight); both bounds are literals, so the filter reaches the parquet scan.
    """
    lo = dt.date.fromisoformat(str(start))
    hi = dt.date.fromisoformat(str(end)) + dt.timedelta(days=1)
    # Bounds typed like the column; from text, so no session/process time zone is involved.
    kind = dict(df.dtypes)[ts]
    kind = kind if kind in ("timestamp", "timestamp_ntz", "date") else "timestamp_ntz"
    lo_c = F.lit(lo.isoformat()).cast(kind)
    hi_c = F.lit(hi.isoformat()).cast(kind)
    return df.where((F.col(ts) >= lo_c) & (F.col(ts) < hi_c))


def drop_keys(df: DataFrame, key: str | Column, keys: Iterable | DataFrame, key_name: str = "_key") -> DataFrame:
    """``df.drop([labels])``: remove rows whose key is in a list.

    A short literal list becomes a filter; a DataFrame of keys becomes a left anti join, for
    lists of any size. Rows whose key is NULL stay in both forms, and NULLs among ``keys``
    drop nothing.
    """
    k = col_(key)
    if isinstance(keys, DataFrame):
        other = keys.select(keys.columns[0]).withColumnRenamed(keys.columns[0], key_name)
        return df.join(other, k == F.col(key_name), "left_anti")
    listed = [x for x in keys if x is not None]
    return df.where(~F.coalesce(k.isin(listed), F.lit(False))) if listed else df


def drop_masked(df: DataFrame, mask: Column) -> DataFrame:
    """``df.drop(df[mask].index)``: a NULL mask does not select, so those rows stay."""
    return df.where(~F.coalesce(mask, F.lit(False)))


def keep_below(df: DataFrame, col: str, limit: Column) -> DataFrame:
    """``df[df[c] < limit]``: rows equal to the limit and NULL rows are dropped."""
    return df.where(F.col(col) < limit)


def drop_above(df: DataFrame, col: str, limit: Column) -> DataFrame:
    """``df.drop(df[df[c] > limit].index)``: rows equal to the limit and NULL rows stay."""
    return drop_masked(df, F.col(col) > limit)


def backfill(df: DataFrame, value: str, order: Sequence[str], out: str | None = None,
             num_buckets: int | None = None) -> DataFrame:
    """``fillna(method='bfill')``: each NULL takes the next valid value in ``order``.

    Trailing NULLs (no later valid value) stay NULL. ``order`` should be a total order.
    """
    out = out or value
    b = ordered_buckets(df, order, num_buckets)
    v = F.col(value)
    # 1) inside each range (ranges are balanced, one window partition each). The next valid
    #    value is the last valid one seen scanning the range backwards: a growing frame,
    #    evaluated incrementally (a CURRENT ROW..UNBOUNDED FOLLOWING frame is re-evaluated
    #    for every row, quadratic in the range size).
    w_in = Window.partitionBy(BUCKET).orderBy(F.col(POS).desc()) \
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = b.withColumn("_fill", F.last(v, ignorenulls=True).over(w_in))
    # 2) per range: its first valid value; then for each range the first valid value of
    #    any later range. One row per range, so the un-partitioned window is bounded.
    first_valid = F.min(F.when(v.isNotNull(), F.struct(F.col(POS).alias("p"), v.alias("v"))))
    per_bucket = b.groupBy(BUCKET).agg(first_valid.getField("v").alias("_first"))
    # the first valid value of any later range = the last one seen scanning ranges backwards
    # (a growing frame again: linear in the number of ranges)
    later = Window.orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(BUCKET, F.last("_first", ignorenulls=True).over(later).alias("_carry"))
    res = filled.join(F.broadcast(carry), BUCKET, "left") \
                .withColumn(out, F.coalesce(F.col("_fill"), F.col("_carry")))
    cols = list(df.columns) + ([out] if out not in df.columns else [])
    return res.select(*cols)


def listwise_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df[cols].dropna()``."""
    return df.select(*cols).na.drop("any")
