"""CSV sources and sinks (S1, S2): explicit schemas, lossless timestamps and doubles.

``inferSchema`` reads the data twice and guesses types; it is offered for exploration only.
Timestamps are written and read with microseconds, so a round trip is lossless; NULL is
written as an empty field and read back as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
DATE_FORMAT = "yyyy-MM-dd"

_OPTIONS = {"header": "true", "timestampNTZFormat": TS_FORMAT, "timestampFormat": TS_FORMAT,
            "dateFormat": DATE_FORMAT, "nullValue": "", "emptyValue": ""}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one CSV part file per partition with a header line."""
    df.write.mode(mode).options(**_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, infer: bool = False) -> DataFrame:
    """``pd.read_csv(path)``: with a schema (production) or inferred types (exploration)."""
    reader = spark.read.options(**_OPTIONS).option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", str(infer).lower()).csv(path)


# What a text looks like that each type holds, the most special type first.
TYPE_PATTERNS = {
    "bigint": r"^[+-]?[0-9]{1,18}$",
    "double": r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?Z?$",
}


def infer_types(texts: DataFrame) -> DataFrame:
    """The most special type that every value of each text column fits, from one aggregate:
    (column_name, inferred_type, n_values, misfits_bigint, misfits_double, misfits_date, misfits_timestamp).

    NULLs do not count; a column without values is a string.
    """
    aggs = []
    for i, c in enumerate(texts.columns):
        x = F.col(f"`{c}`")
        aggs.append(F.count(x).alias(f"n{i}"))
        aggs += [F.count_if(~x.rlike(p)).alias(f"{t}{i}") for t, p in TYPE_PATTERNS.items()]
    row = texts.agg(*aggs)
    entries = []
    for i, c in enumerate(texts.columns):
        kind = F.lit("string")
        for t in reversed(TYPE_PATTERNS):
            kind = F.when((F.col(f"n{i}") > 0) & (F.col(f"{t}{i}") == 0), t).otherwise(kind)
        entries.append(F.struct(F.lit(c).alias("column_name"), kind.alias("inferred_type"), F.col(f"n{i}").alias("n_values"),
                                *[F.col(f"{t}{i}").alias(f"misfits_{t}") for t in TYPE_PATTERNS]))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def with_inferred_types(texts: DataFrame) -> DataFrame:
    """``texts`` cast to the inferred types (one row per column is read back)."""
    kinds = {r.column_name: r.inferred_type for r in infer_types(texts).collect()}
    cast = {"timestamp": "timestamp_ntz"}
    return texts.select(*[F.col(f"`{c}`").cast(cast.get(kinds[c], kinds[c])).alias(c) for c in texts.columns])


def read_series_csv(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """``pd.read_csv(path, index_col=0, parse_dates=True)``: the key column is read as text
    and parsed to the schema's date/timestamp type (ANSI: unparsable text fails, as pandas
    raises). It stays an ordinary column; row order is never implicit in Spark."""
    if key not in schema.fieldNames():
        raise KeyError(key)
    as_text = StructType([StructField(f.name, StringType(), True) if f.name == key else f for f in schema.fields])
    target = schema[key].dataType
    return read_csv(spark, path, as_text).withColumn(key, F.col(key).cast(target))
