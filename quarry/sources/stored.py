"""Tables stored for how they are read: bucketed by a join key, clustered by day, audited while written.

* ``store_bucketed`` – a catalogue table hashed and sorted by its key. Tables of equal keys and
  bucket counts join without an exchange, and a window or aggregate by the key needs none.
* ``store_by_day`` – a time series in one folder a day, so a slice reads its days' files only;
  ``days_where`` slices through a per-day summary, whose days prune the files at run time.
* ``store_audited`` – writes a table and returns what the same scan saw of it: row and NULL
  counts and counts of named checks, through metrics observed on the write.

All of them lie in the run's shared folder and go, files included, with ``catalog.drop_if_exists``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .catalog import check_free, own, select_into

DAY = "day"


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of files or folders, in whatever store they lie."""
    total = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return int(total)


def bucket_count(input_bytes: int, target_bytes: int = 256 << 20, least: int = 8) -> int:
    """Buckets of about ``target_bytes``: a power of two, so that tables of like size get equal counts."""
    wanted = max(least, -(-input_bytes // target_bytes))
    return 1 << (wanted - 1).bit_length()


def store_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int, sort_by: Sequence[str] | None = None) -> DataFrame:
    """``select into`` a table of ``buckets`` buckets by ``by``, sorted inside each (by ``by`` unless told).

    Rows are shuffled once, here, with the hash that the buckets use: one task and one file per
    bucket. Equal keys share a bucket, so choose a key few rows share – (location, date), not
    location, where one location holds a third of the rows. Fails if the name exists.
    """
    spark = df.sparkSession
    check_free(spark, name)
    path, by = scratch_path(spark, name), list(by)
    (df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by)
       .sortBy(*(sort_by or by)).option("path", path).saveAsTable(name))
    own(spark, name, path)
    return spark.table(name)


def store_by_day(df: DataFrame, name: str, ts: str, spread: Sequence[str], files: int) -> DataFrame:
    """``select into`` one folder per day of ``ts``; the table gains the date column ``day``.

    About ``files`` equal ranges of (day, ``spread``) are written: short days share a task, a day
    that holds a third of the rows is cut over many. Rows without a time go to a folder of their own.
    """
    if DAY in df.columns:
        raise ValueError(f"the table has a column {DAY!r} already")
    spark = df.sparkSession
    check_free(spark, name)
    path = scratch_path(spark, name)
    by_day = df.withColumn(DAY, F.to_date(ts)).repartitionByRange(files, DAY, *spread)
    by_day.sortWithinPartitions(DAY, ts).write.partitionBy(DAY).parquet(path)
    if stored_bytes(spark, path):
        out = spark.read.schema(by_day.schema).parquet(path)
    else:
        out = spark.createDataFrame([], by_day.schema)
    out.createOrReplaceTempView(name)
    own(spark, name, path)
    return out


def day_summary(by_day: DataFrame, name: str, *measures: Column) -> DataFrame:
    """``select into`` one row per day of a ``store_by_day`` table: day and the aggregates given."""
    return select_into(by_day.groupBy(DAY).agg(*measures), name)


def days_where(by_day: DataFrame, summary: DataFrame, condition: Column) -> DataFrame:
    """The rows of the days whose summary meets ``condition``; other days' files are not opened.

    The summary is a small stored table, so Spark broadcasts it by its measured size and prunes the
    day folders with the days found (dynamic partition pruning). A summary too large for
    that is joined by shuffle instead: same rows, no pruning.
    """
    return by_day.join(summary.where(condition).select(DAY), DAY, "left_semi").select(*by_day.columns)


def store_audited(df: DataFrame, name: str, checks: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``select into``, and its audit: (table, (column_name, measure, n)).

    The audit has ``rows`` (column_name NULL), ``nulls`` of each column, and for each named check
    how many rows meet it (column_name NULL). One scan yields both. The counts are taken in the
    task that writes, after every shuffle, so a task that ran twice counts once.
    """
    checks = dict(checks or {})
    measures = [(None, "rows", F.count(F.lit(1)))]
    measures += [(c, "nulls", F.count_if(df[f"`{c}`"].isNull())) for c in df.columns]
    measures += [(None, label, F.count_if(condition)) for label, condition in checks.items()]
    seen = Observation()
    table = select_into(df.observe(seen, *[m.alias(f"m{i}") for i, (_, _, m) in enumerate(measures)]), name)
    counts = seen.get
    rows = [(c, label, int(counts[f"m{i}"])) for i, (c, label, _) in enumerate(measures)]
    return table, df.sparkSession.createDataFrame(rows, "column_name string, measure string, n long")
