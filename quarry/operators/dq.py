"""Inspection and data quality (I1–I11): shape, types, nulls, duplicates.

Duplicate handling never sorts a whole duplicate group in one task: the first row of a
group is found with a partial aggregate (``min`` of the row-order key), so a key holding
a third of the table costs one partial row per map task; the rows that repeat an
earlier one are then an anti join on the (unique) row key, which shuffles evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape(df: DataFrame) -> DataFrame:
    """``df.shape`` as a one-row frame (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """``df.dtypes``: schema metadata, no job runs."""
    return df.dtypes


def describe_numeric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df.describe()`` for numeric columns in long form, one row per column.

    count, mean, std (sample), min, exact interpolated 25/50/75 %, max: one summary with
    sketch brackets, which reads the input twice and writes nothing.
    """
    from .order_stats import summarise
    from .stats import long_values
    out = summarise(long_values(df, cols), "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column_name"])
    return out.select("column_name", F.col("n").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``s.isna().values.any()`` per column: (column_name, has_null)."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in cols])
    return row.unpivot([], cols, "column_name", "has_null").withColumn("has_null", F.coalesce("has_null", F.lit(False)))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``df.isna().sum()``: (column_name, n_null) from one aggregate pass."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.unpivot([], cols, "column_name", "n_null")


def null_rows(df: DataFrame, col: str) -> DataFrame:
    """``df.loc[df[c].isna()]``."""
    return df.where(F.col(col).isNull())


def first_row_keys(df: DataFrame, subset: Sequence[str], order_key: str) -> DataFrame:
    """Row key of the first row (by ``order_key``) of each group of equal ``subset`` values.

    NULLs compare equal inside a subset (as pandas' ``duplicated`` treats NaN).
    """
    return df.groupBy(*subset).agg(F.min(order_key).alias(order_key)).select(order_key)


def duplicated_rows(df: DataFrame, order_key: str, subset: Sequence[str] | None = None) -> DataFrame:
    """``df.loc[df.duplicated(subset)]``: rows repeating an earlier row (from the second on).

    ``subset`` defaults to every column except the row-order key.
    """
    subset = list(subset or [c for c in df.columns if c != order_key])
    return df.join(first_row_keys(df, subset, order_key), order_key, "left_anti")


def drop_duplicates_keep_first(df: DataFrame, order_key: str, subset: Sequence[str] | None = None) -> DataFrame:
    """``df.loc[~df.duplicated(subset)]``: keep the first row of each group, by row order.

    The smallest order key of each group is a hash aggregate of the subset alone, and the
    rows come back by a semi join on that key (which must be unique), so a hot group is
    reduced map-side and only the columns a caller goes on to use are read.
    """
    subset = list(subset or [c for c in df.columns if c != order_key])
    if order_key in subset:
        raise ValueError("order_key must not be part of the subset")
    return df.join(first_row_keys(df, subset, order_key), order_key, "left_semi").select(*df.columns)
