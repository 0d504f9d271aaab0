"""Order statistics by sketch brackets and tiles by border rows: brute force, ties, empty tables, plans."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import order_stats, tiles
from quarry.operators.order_stats import summarise

PROBS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "high": 1.0}


def sample(n, seed):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.35
    return [(("a", "b")[int(g)], None if m else float(v)) for g, m, v in zip(
        rng.integers(0, 2, n), rng.random(n) < 0.1, np.where(hot, 5.0, np.round(rng.standard_normal(n) * 100, 3)))]


@pytest.mark.parametrize("n", [1, 2, 7, 500, 30_000])
def test_summary_equals_numpy(spark, n):
    rows = sample(n, n)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in summarise(df, "v", PROBS, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        v = np.array([x for k, x in rows if k == g and x is not None])
        r = got[g]
        assert r.n == len(v)
        if len(v):
            assert [r[c] for c in PROBS] == pytest.approx(np.quantile(v, list(PROBS.values())).tolist(), rel=1e-12)
            assert (r.min, r.max) == (v.min(), v.max()) and r["mean"] == pytest.approx(v.mean())
            assert r["std"] == (pytest.approx(v.std(ddof=1)) if len(v) > 1 else None)
    whole = summarise(df, "v", {"mid": 0.5}).first()
    values = [x for _, x in rows if x is not None]
    assert whole.mid == (pytest.approx(np.median(values)) if values else None)


def test_summary_of_empty_null_and_nan(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), (None, 2.0), ("c", float("nan")), ("d", float("inf")), ("d", 1.0)], "g string, v double")
    got = {r.g: (r.n, r.mid) for r in summarise(df, "v", {"mid": 0.5}, ["g"]).collect()}
    assert got == {"a": (0, None), "b": (1, 1.0), "c": (0, None), "d": (2, float("inf"))}
    assert summarise(df.limit(0), "v", {"mid": 0.5}).collect()[0].n == 0
    assert summarise(df.limit(0), "v", {"mid": 0.5}, ["g"]).count() == 0


def test_only_values_inside_brackets_are_ordered(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "hash(id) / 1e6 AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = summarise(df, "v", {"mid": 0.5})
    values = sorted(r.v for r in df.collect())
    assert out.first().mid == (values[99_999] + values[100_000]) / 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "rangepartitioning" not in plan and "RDDScan" not in plan


def test_a_lost_rank_raises(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "MARGIN", -3)      # brackets that cannot hold their ranks
    df = spark.range(100_000).selectExpr("id % 99991 AS v")
    with pytest.raises(Exception, match="outside its sketch bracket"):
        summarise(df, "v", {"mid": 0.5}).collect()


def text_key(i):
    return "x" * i if i < 40 else f"é{i}same{i % 7}"


@pytest.mark.parametrize(("n", "key", "kind"), [
    (6000, lambda i: f"Customer#{i:09d}", "string"), (3000, text_key, "string"), (5000, lambda i: 3 * i - 999, "long"),
    (3, str, "string"), (1, str, "string")])
def test_tiles_equal_ntile(spark, n, key, kind):
    rng = random.Random(n)
    rows = [(key(i), float(rng.choice([1, 1, 1, 2, 2, rng.random() * 9])), rng.randint(0, 3), None if rng.random() < 0.1 else rng.random())
            for i in range(n)]
    df = spark.createDataFrame(rows, f"c {kind}, a double, f int, r double").repartition(4)
    got = tiles.ntiles(df, 4, {"ta": "a", "tf": "f", "tr": ("r", True), "up": "r"}, "c")

    def expected(*order):
        return F.ntile(4).over(Window.orderBy(*order))
    both = got.withColumns({"ea": expected("a", "c"), "ef": expected("f", "c"), "er": expected(F.col("r").desc(), "c"), "eu": expected("r", "c")})
    assert both.where("ta <> ea OR tf <> ef OR tr <> er OR up <> eu").count() == 0 and got.count() == n


def test_tiles_need_no_shuffle_of_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v")
    out = tiles.ntiles(df, 3, {"t": "v"}, "id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert tiles.ntiles(df.limit(0), 3, {"t": "v"}, "id").count() == 0
    with pytest.raises(ValueError):
        tiles.ntiles(df.selectExpr("v", "date '2020-01-01' AS d"), 3, {"t": "v"}, "d")
