"""Query registry: name → (Spark plan builder, oracle SQL for DuckDB).

A plan builder takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables of
that folder. Checkpoints, written tables, one-row chart parameters and model fits run while
it is built; the rest is lazy. The oracle SQL computes the same result independently from the
raw tables (views inlined as CTEs); queries whose result is not expressible in SQL
(model fits, resampling) register no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

PlanFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, PlanFn] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), covers: str = ""):
    """Register a plan builder under ``name`` with its oracle SQL body and views."""
    def deco(fn: PlanFn) -> PlanFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import coasters, covid, prices, readme, sales  # noqa: F401
