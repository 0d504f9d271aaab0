"""Distributed rank, ntile and exact quantiles against built-ins and hand-computed values."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from quarry.operators.rank import exact_quantiles, global_row_number, ntile


def test_ntile_five_keys(spark):
    df = spark.range(1, 6).withColumnRenamed("id", "k")
    out = ntile(df, 4, ["k"], "t").orderBy("k")
    assert rows(out, "t") == [(1,), (1,), (2,), (3,), (4,)]


def test_ntile_fewer_rows_than_tiles(spark):
    df = spark.range(1, 4).withColumnRenamed("id", "k")
    assert rows(ntile(df, 4, ["k"], "t").orderBy("k"), "t") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("buckets", [1, 3, 8, 17])
def test_ntile_matches_builtin_window(spark, buckets):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value")
    mine = ntile(ev, 4, ["value", "event_id"], "t", num_buckets=buckets)
    ref = ev.withColumn("t", F.ntile(4).over(Window.orderBy("value", "event_id")))
    assert mine.join(ref, ["event_id"]).where(mine.t != ref.t).count() == 0
    assert mine.count() == ev.count()


def test_row_number_with_hot_value(spark):
    # a third of the rows share one value: the tie-break key still splits the ranges
    df = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
    out = global_row_number(df, ["v", "id"], "rn", num_buckets=8)
    ref = df.withColumn("rn2", F.row_number().over(Window.orderBy("v", "id")))
    assert out.join(ref, "id").where(F.col("rn") != F.col("rn2")).count() == 0


def test_exact_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    q = exact_quantiles(df, "x", {"q20": 0.2, "med": 0.5, "q25": 0.25, "q75": 0.75}).first()
    assert q["q20"] == pytest.approx(1.6)
    assert q["med"] == pytest.approx(2.5)
    assert (q["q25"], q["q75"]) == (pytest.approx(1.75), pytest.approx(3.25))


def test_grouped_quantiles_match_percentile(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    mine = exact_quantiles(ev, "value", {"m": 0.5, "p9": 0.9}, ["event_type"])
    ref = ev.groupBy("event_type").agg(F.percentile("value", 0.5).alias("m2"), F.percentile("value", 0.9).alias("p92"))
    for r in mine.join(ref, "event_type").collect():
        assert r["m"] == pytest.approx(r["m2"]) and r["p9"] == pytest.approx(r["p92"])


def test_quantiles_with_a_hot_value_spread_over_ranges(spark):
    # a third of the rows share one value; the ranges must still be balanced
    df = spark.range(0, 9000).select("id", F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") / 7).alias("x"))
    from quarry.operators.rank import ordered_buckets
    b = ordered_buckets(df.withColumn("_t", F.xxhash64("id", "x")), ["x", "_t"], num_buckets=6)
    sizes = [r[1] for r in b.groupBy("_bucket").count().collect()]
    assert max(sizes) < 9000 / 3
    q = exact_quantiles(df, "x", {"m": 0.5, "p1": 0.1}).first()
    ref = df.agg(F.percentile("x", 0.5), F.percentile("x", 0.1)).first()
    assert (q["m"], q["p1"]) == (pytest.approx(ref[0]), pytest.approx(ref[1]))


def test_quantiles_on_a_frame_with_a_map_column(spark):
    df = spark.createDataFrame([(1.0, {"a": 1}), (2.0, {"b": 2}), (4.0, None)], "x double, m map<string,int>")
    assert exact_quantiles(df, "x", {"m": 0.5}).first()["m"] == 2.0
