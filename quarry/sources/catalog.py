"""Temp tables and views (S4–S8) in Spark terms.

* ``select … into #t`` → the result written as parquet into the shared checkpoint folder
  and registered under a name: later reads do not recompute the query, and the lineage
  is cut, so an executor loss does not re-run the upstream joins.
* ``create table #t(...); insert into #t select …`` → positional assignment of the
  query's columns to a declared schema with casts (values coerced to the declared types).
* ``create view v as …`` → a session temp view (no data stored).
* ``drop table if exists`` → drop the name and the files that were written for it; idempotent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import delete_folder, scratch_path

_OWNED = "quarry.table."


def unique_name(name: str) -> str:
    """``name`` with a suffix of its own, so that two builds in one session do not replace each other's tables."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def drop_if_exists(spark: SparkSession, name: str) -> None:
    """Drop a table or view; files that this library wrote for it go with it, those of others stay."""
    if not spark.catalog.dropTempView(name) and spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE `{name}`")
    path = spark.conf.get(_OWNED + name, None)
    if path:
        delete_folder(spark, path)
        spark.conf.unset(_OWNED + name)


def check_free(spark: SparkSession, name: str) -> None:
    """Raise if the name is taken, as ``select into`` does."""
    if spark.catalog.tableExists(name):
        raise ValueError(f"{name} already exists; drop it first")


def own(spark: SparkSession, name: str, path: str) -> None:
    """Note that the files below ``path`` belong to the table and go when it is dropped."""
    spark.conf.set(_OWNED + name, path)


def coerce_to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Insert-from-query semantics: columns assigned by position, cast to declared types."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"insert has {len(df.columns)} columns, table declares {len(schema.fields)}")
    return df.select(*[df[c].cast(f.dataType).alias(f.name) for c, f in zip(df.columns, schema.fields)])


def select_into(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` under ``name`` (fails if the name exists, like ``select into``)."""
    spark = df.sparkSession
    check_free(spark, name)
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    out.createOrReplaceTempView(name)
    own(spark, name, path)
    return out


def create_typed_table(spark: SparkSession, name: str, schema: StructType, rows: DataFrame) -> DataFrame:
    """``create table #t(<schema>); insert into #t <rows>`` → materialised, typed table."""
    return select_into(coerce_to_schema(rows, schema), name)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """``create or replace view``: a named query; nothing is stored."""
    df.createOrReplaceTempView(name)
    return df


def read_back(spark: SparkSession, name: str) -> DataFrame:
    """``select * from #t`` / ``from v``."""
    return spark.table(name)
