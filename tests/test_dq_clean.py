"""Inspection, duplicates, back-fill, slices, outlier removal on literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quarry.functions.scalar import nan_to_null
from quarry.operators import clean, dq

D = dt.date(2020, 1, 1)


@pytest.fixture()
def dups(spark):
    return spark.createDataFrame([(1, "x", "L", D), (2, "x", "L", D), (3, "x", "M", D), (4, None, "L", D),
                                  (5, None, "L", D)], "row_id long, name string, loc string, d date")


def test_keep_first_and_list_duplicates(dups):
    kept = dq.drop_duplicates_keep_first(dups, "row_id", ["name", "loc", "d"]).orderBy("row_id")
    assert rows(kept, "row_id") == [(1,), (3,), (4,)]
    assert kept.columns == dups.columns
    later = dq.duplicated_rows(dups, "row_id", ["name", "loc", "d"]).orderBy("row_id")
    assert rows(later, "row_id") == [(2,), (5,)]


def test_duplicates_all_columns(dups):
    assert rows(dq.duplicated_rows(dups, "row_id").orderBy("row_id"), "row_id") == [(2,), (5,)]


def test_null_audit(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (None, None)], "a int, b double")
    assert dict(rows(dq.null_counts(df))) == {"a": 1, "b": 2}
    assert dict(rows(dq.any_null(df))) == {"a": True, "b": True}
    assert rows(dq.shape(df)) == [(3, 2)]


@pytest.fixture()
def gaps(spark):
    vals = [None, 5.0, None, None, 8.0, None]
    return spark.createDataFrame([(i + 1, dt.datetime(2020, 1, 1, i), v) for i, v in enumerate(vals)],
                                 "k long, ts timestamp_ntz, v double")


@pytest.mark.parametrize("buckets", [1, 2, 6])
def test_backfill(gaps, buckets):
    out = clean.backfill(gaps, "v", ["ts", "k"], out="f", num_buckets=buckets).orderBy("k")
    assert rows(out, "f") == [(5.0,), (5.0,), (8.0,), (8.0,), (8.0,), (None,)]


def test_backfill_matches_window(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    gappy = ev.select("event_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    from pyspark.sql import Window
    w = Window.orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    ref = gappy.withColumn("g", F.first("v", ignorenulls=True).over(w))
    mine = clean.backfill(gappy, "v", ["ts", "event_id"], out="f", num_buckets=7)
    assert mine.join(ref, "event_id").where(~F.col("f").eqNullSafe(F.col("g"))).count() == 0


def test_any_null_and_rows(gaps):
    assert rows(dq.any_null(gaps, ["v"])) == [("v", True)]
    assert dq.null_rows(gaps, "v").count() == 4


def test_date_slice_end_day_inclusive(spark):
    ts = [dt.datetime(2020, 1, 6, 23), dt.datetime(2020, 1, 7), dt.datetime(2020, 1, 11, 18), dt.datetime(2020, 1, 12)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    assert clean.date_slice(df, "ts", "2020-01-07", "2020-01-11").count() == 2


def test_two_outlier_removals_differ(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    lim = F.lit(3.0)
    assert sorted(rows(clean.keep_below(df, "x", lim))) == [(1.0,), (2.0,)]
    kept = rows(clean.drop_above(df, "x", lim))
    assert sorted(kept, key=lambda r: (r[0] is None, r[0])) == [(1.0,), (2.0,), (3.0,), (None,)]


def test_drop_keys_list_and_frame(spark):
    df = spark.range(10)
    assert clean.drop_keys(df, "id", [1, 2]).count() == 8
    assert clean.drop_keys(df, "id", spark.range(5)).count() == 5
    with_null = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    drop = spark.createDataFrame([(1,), (None,)], "k long")
    for keys in ([1, None], drop):
        assert sorted(map(str, (r.id for r in clean.drop_keys(with_null, "id", keys).collect()))) == ["2", "None"]


def test_nan_to_null(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"), ["x"])
    r = df.agg(F.avg("x"), F.count("x")).first()
    assert (r[0], r[1]) == (1.0, 1)
