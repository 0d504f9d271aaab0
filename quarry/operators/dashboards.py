"""Dashboard aggregates declared in the reference's README."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals_by_dimensions(df: DataFrame, dims: Sequence[str], measures: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Totals of several measures by each of several dimensions, in long form.

    (dimension, dim_value, <measures…>, n_lines). The rows are totalled once over all
    dimensions together (partial aggregation; the dimensions are categories with few
    values), and only that table is expanded once per dimension.
    """
    cells = df.groupBy(*[F.col(c).cast("string").alias(c) for c in dims]).agg(
        *[F.sum(src).alias(f"_m_{alias}") for alias, (src, _) in measures.items()], F.count(F.lit(1)).alias("_n"))
    long = cells.unpivot([*[f"_m_{a}" for a in measures], "_n"], list(dims), "dimension", "dim_value")
    aggs = []
    for alias, (_, cast) in measures.items():
        s = F.sum(f"_m_{alias}")
        aggs.append((s.cast(cast) if cast else s).alias(alias))
    return long.groupBy("dimension", "dim_value").agg(*aggs, F.sum("_n").alias("n_lines"))


def rate_by_attributes(df: DataFrame, flag: str, dims: Sequence[str]) -> DataFrame:
    """Rate of a 0/1 flag (e.g. attrition) and row count per value of each dimension."""
    base = df.select(*[F.col(c).cast("string").alias(c) for c in dims], F.col(flag).alias("_flag"))
    long = base.unpivot(["_flag"], list(dims), "dimension", "dim_value")
    return long.groupBy("dimension", "dim_value").agg(
        F.avg(F.col("_flag").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
