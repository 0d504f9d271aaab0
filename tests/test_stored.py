"""Tables stored by bucket and by day, and audits taken while writing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from quarry.plans.registry import QUERIES, load_all
from quarry.sources import catalog, stored

load_all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _folder(table):
    return os.path.dirname(table.inputFiles()[0].replace("file://", ""))


def test_bucketed_tables_join_and_window_without_exchange(spark, no_broadcast):
    for name in ("bucketed_join", "bucketed_running_total"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "SortMergeJoin" in _plan(QUERIES["bucketed_join"](spark, SF_SMALL))
    assert "Exchange" in _plan(QUERIES["rolling_vaccinations"](spark, SF_SMALL))


def test_bucketed_table_keeps_rows_names_and_drops_its_files(spark):
    name = catalog.unique_name("b")
    df = spark.createDataFrame([(k % 3 if k % 4 else None, "it's", k) for k in range(40)], "k long, `odd name` string, v long")
    table = stored.store_bucketed(df, name, ["k"], 4)
    assert sorted(rows(table, "v")) == [(k,) for k in range(40)] and table.columns == df.columns
    assert rows(catalog.read_back(spark, name).where("k is null").agg(F.count("*"))) == [(10,)]
    folder = _folder(table)
    with pytest.raises(ValueError, match="exists"):
        stored.store_bucketed(df, name, ["k"], 4)
    catalog.drop_if_exists(spark, name)
    assert not os.path.exists(folder) and not spark.catalog.tableExists(name)
    catalog.drop_if_exists(spark, name)
    assert stored.store_bucketed(df.limit(0), name, ["k"], 4).count() == 0
    catalog.drop_if_exists(spark, name)


def test_bucket_count_follows_the_bytes():
    assert [stored.bucket_count(n) for n in (0, 1 << 28, 9 << 28, 100 << 40)] == [8, 8, 16, 1 << 19]


def _series(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(k, at + dt.timedelta(hours=7 * k), None if k % 10 < 4 and k > 20 else float(k)) for k in range(60)]
    return spark.createDataFrame(data + [(60, None, 1.0)], "id long, ts timestamp_ntz, v double")


def test_a_slice_by_day_opens_the_files_of_its_days_only(spark):
    df = _series(spark)
    table = stored.store_by_day(df, catalog.unique_name("d"), "ts", ["id"], 4)
    summary = stored.day_summary(table, catalog.unique_name("s"), F.count("v").alias("n"), F.min("id").alias("first"))
    assert sorted(rows(table, "id")) == sorted(rows(df, "id"))
    few = stored.days_where(table, summary, F.col("n") == 1)
    want = sorted(r.id for r in df.withColumn("d", F.to_date("ts")).join(
        df.groupBy(F.to_date("ts").alias("d")).agg(F.count("v").alias("n")).where("n = 1"), "d", "left_semi").collect())
    assert want and "dynamicpruning" in _plan(few)
    days = {str(r.day) for r in summary.where("n = 1").collect()}
    broken = 0
    for f in {f.replace("file://", "") for f in table.inputFiles()}:
        if f.split("day=")[1].split("/")[0] not in days:          # a file that must not be read
            with open(f, "wb") as out:
                out.write(b"no parquet")
            checksum = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
            os.path.exists(checksum) and os.remove(checksum)
            broken += 1
    assert broken and sorted(r.id for r in few.collect()) == want
    with pytest.raises(Exception):
        table.agg(F.sum("v")).collect()


def test_a_day_of_many_rows_is_cut_over_files_and_empty_series_are_stored(spark):
    hot = spark.range(4000).select(F.col("id"), F.lit("2024-05-05 10:00:00").cast("timestamp_ntz").alias("ts"))
    table = stored.store_by_day(hot, catalog.unique_name("hot"), "ts", ["id"], 8)
    assert len(table.inputFiles()) >= 4 and table.count() == 4000
    empty = stored.store_by_day(hot.limit(0), catalog.unique_name("none"), "ts", ["id"], 8)
    assert empty.count() == 0 and empty.columns == ["id", "ts", "day"]
    with pytest.raises(ValueError, match="day"):
        stored.store_by_day(table, catalog.unique_name("twice"), "ts", ["id"], 8)


def test_audit_and_table_come_from_one_scan(spark):
    df = spark.createDataFrame([(k % 5, None if k % 3 else "x", float(k)) for k in range(30)], "g long, `a b` string, v double")
    tally = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            tally.add(b.num_rows)
            yield b

    table, audit = stored.store_audited(df.mapInArrow(passed, df.schema), catalog.unique_name("a"), {"small": F.col("v") < 3})
    got = {(r.column_name, r.measure): r.n for r in audit.collect()}
    assert got == {(None, "rows"): 30, ("g", "nulls"): 0, ("a b", "nulls"): 20, ("v", "nulls"): 0, (None, "small"): 3}
    assert table.count() == 30 and tally.value == 30
    nothing, audit = stored.store_audited(df.limit(0), catalog.unique_name("a"))
    assert nothing.count() == 0 and {r.n for r in audit.collect()} == {0}
