"""CSV source/sink and temp-table semantics."""

import datetime as dt

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from quarry.session import scratch_path
from quarry.sources import catalog, csv

SCHEMA = StructType([StructField("k", LongType()), StructField("ts", TimestampNTZType()),
                     StructField("x", DoubleType())])


def _frame(spark):
    return spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), 0.1),
                                  (2, dt.datetime(2024, 1, 3), None)], SCHEMA)


def test_csv_round_trip_is_lossless(spark):
    path = scratch_path(spark, "t-csv")
    csv.write_csv(_frame(spark), path)
    back = csv.read_series_csv(spark, path, SCHEMA, "ts").orderBy("k").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in _frame(spark).orderBy("k").collect()]


def test_csv_inferred_schema_for_exploration(spark):
    path = scratch_path(spark, "t-csv-infer")
    csv.write_csv(_frame(spark), path)
    inferred = csv.read_csv(spark, path, infer=True)
    assert dict(inferred.dtypes)["k"] in ("int", "bigint") and dict(inferred.dtypes)["x"] == "double"


def test_typed_insert_is_positional_and_checked(spark):
    declared = StructType([StructField("a", StringType()), StructField("b", LongType())])
    rows = spark.createDataFrame([(7.6, "x")], "p double, q string")
    with pytest.raises(Exception):
        catalog.coerce_to_schema(rows.select("p"), declared).collect()          # column count differs
    # position 1 → a (text), position 2 → b (bigint, ANSI cast of 'x' fails like the server's insert)
    with pytest.raises(Exception):
        catalog.coerce_to_schema(rows, declared).collect()
    ok = spark.createDataFrame([(7.6, "12")], "p double, q string")
    assert catalog.coerce_to_schema(ok, declared).collect()[0] == ("7.6", 12)


def test_select_into_refuses_an_existing_name(spark):
    catalog.drop_if_exists(spark, "t_into")
    catalog.select_into(spark.range(3), "t_into")
    with pytest.raises(ValueError):
        catalog.select_into(spark.range(3), "t_into")
    assert catalog.read_back(spark, "t_into").count() == 3
    catalog.drop_if_exists(spark, "t_into")
    catalog.drop_if_exists(spark, "t_into")                                   # idempotent


def test_cli_lists_every_registered_analysis(capsys):
    from quarry.cli import main
    from quarry.plans.registry import QUERIES, load_all
    load_all()
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert all(name in out for name in QUERIES)
    assert main(["run", "no_such_query", "--sf", "/nowhere"]) == 2


def test_drop_removes_the_files_it_owns(spark):
    import os
    import urllib.parse

    from quarry.session import remove_scratch, run_folder, scratch_path
    name = catalog.unique_name("t_files")
    out = catalog.select_into(spark.range(3), name)
    folder = os.path.dirname(urllib.parse.urlparse(out.inputFiles()[0]).path)
    assert os.path.isdir(folder)
    other = catalog.unique_name("t_files")
    kept = catalog.select_into(spark.range(2), other)
    catalog.create_view(spark.read.parquet(folder), "v_files")
    catalog.drop_if_exists(spark, "v_files")                                   # a view owns nothing
    assert os.path.isdir(folder)
    catalog.drop_if_exists(spark, name)
    assert not os.path.exists(folder) and not spark.catalog.tableExists(name) and kept.count() == 2
    catalog.drop_if_exists(spark, other)
    assert scratch_path(spark, "x").startswith(run_folder(spark)) and callable(remove_scratch)


def test_types_are_inferred_from_all_values(spark):
    rows = [("1", "1.5", "2024-01-06", "2024-01-06T00:00:00", "x", None), ("-2", "2", "2024-02-30", "2024-01-06 01:02:03.5Z", "1", None),
            (None, "1e5", None, None, "2", None)]
    texts = spark.createDataFrame(rows, "i string, d string, day string, ts string, t string, none string")
    got = {r.column_name: (r.inferred_type, r.n_values, r.misfits_bigint, r.misfits_double) for r in csv.infer_types(texts).collect()}
    assert got == {"i": ("bigint", 2, 0, 0), "d": ("double", 3, 2, 0), "day": ("date", 2, 2, 2), "ts": ("timestamp", 2, 2, 2),
                   "t": ("string", 3, 1, 1), "none": ("string", 0, 0, 0)}
    typed = csv.with_inferred_types(texts.select("i", "d", "t"))
    assert typed.dtypes == [("i", "bigint"), ("d", "double"), ("t", "string")] and typed.first().d == 1.5
