"""Exploration, rates, running totals, RFM, baskets, statistics and charts on literal frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quarry.functions.scalar import day_diff, pct, to_bigint, to_int
from quarry.operators import basket, charts, explore, rfm, rolling, stats


def test_text_max_is_lexicographic_numeric_max_is_not(spark):
    df = spark.createDataFrame([("a", "9"), ("a", "10"), ("a", "100"), ("b", None)], "k string, v string")
    text = dict(rows(df.groupBy("k").agg(F.max("v"))))
    num = dict(rows(df.groupBy("k").agg(F.max(to_int("v")))))
    assert text["a"] == "9" and num["a"] == 100 and num["b"] is None
    peak = explore.rows_at_group_max(df, ["k"], to_int("v"))
    assert rows(peak, "k", "v") == [("a", "100")]          # all-NULL group drops out


def test_case_insensitive_like(spark):
    df = spark.createDataFrame([("United States",), ("united states",), ("Landia",), (None,)], "location string")
    assert df.where(F.col("location").ilike("%states%")).count() == 2


def test_percentage_with_zero_denominator(spark):
    df = spark.createDataFrame([(5, 10), (0, 0), (None, 3)], "d int, c int")
    assert rows(df.select(pct("d", "c"))) == [(50.0,), (None,), (None,)]


def test_running_total_peers_share(spark):
    d1, d2, d3 = dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 1, 3)
    df = spark.createDataFrame([(1, "A", d1, "3"), (2, "A", d1, "2"), (3, "A", d2, None), (4, "A", d3, "4"),
                                (5, "B", d1, "7")], "i int, loc string, d date, v string")
    for pre in (True, False):
        out = rolling.running_total(df, ["loc"], "d", to_bigint("v"), "run", pre_aggregate=pre).orderBy("i")
        assert rows(out, "run") == [(5,), (5,), (5,), (9,), (7,)]


def test_bigint_running_total_does_not_overflow(spark):
    df = spark.createDataFrame([("A", 1, "2147483647"), ("A", 2, "1")], "loc string, d int, v string")
    out = rolling.running_total(df, ["loc"], "d", to_bigint("v"), "run").orderBy("d")
    assert rows(out, "run")[-1] == (2147483648,)


def test_day_difference_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 23, 59, 59), dt.datetime(2020, 1, 2, 0, 0, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert rows(df.select(day_diff("a", "b"))) == [(1,)]


def test_segment_labels(spark):
    codes = ["111", "133", "311", "222", "323", "444", "424"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = [r[0] for r in df.select(rfm.segment_label("code")).collect()]
    assert got == ["Lost customers", "Slipping customer, cannot lose", "New customers", "Potential churner",
                   "Active", "Loyal", None]
    assert sum(len(v) for v in rfm.SEGMENT_CODES.values()) == 34


def test_rfm_scores_small(spark):
    d = dt.datetime
    sales = spark.createDataFrame(
        [("a", 1, 10.0, d(2020, 1, 1)), ("b", 2, 20.0, d(2020, 1, 5)), ("b", 3, 5.0, d(2020, 1, 2)),
         ("c", 4, 1.0, d(2020, 1, 3)), ("d", 5, 2.0, d(2020, 1, 4))],
        "customername string, ordernumber int, sales double, orderdate timestamp_ntz")
    base = rfm.rfm_base(sales)
    got = {r["customername"]: r for r in rfm.rfm_scores(base).collect()}
    assert got["b"]["recency"] == 0 and got["a"]["recency"] == 4
    assert got["b"]["frequency"] == 2 and got["b"]["avg_monetary_value"] == pytest.approx(12.5)
    assert got["b"]["rfm_recency"] == 1 and got["a"]["rfm_recency"] == 4
    assert got["b"]["rfm_cell_string"] == f"{got['b']['rfm_recency']}{got['b']['rfm_frequency']}{got['b']['rfm_monetary']}"


def test_basket_lists_and_pairs(spark):
    lines = spark.createDataFrame(
        [(1, "B", "F"), (1, "A", "F"), (2, "A", "F"), (2, "B", "F"), (3, "A", "F"),
         (4, "A", "F"), (4, "B", "F"), (4, "C", "X")], "ordernumber int, productcode string, status string")
    lists = dict(rows(basket.order_code_lists(lines, 2, "F")))
    assert lists == {1: "A,B", 2: "A,B", 3: None, 4: "A,B,C"}
    pairs = dict(rows(basket.code_set_frequency(basket.order_code_lists(lines, 2, "F"))))
    assert pairs == {"A,B": 2, "A,B,C": 1}
    assert basket.lines_of_n_line_orders(lines, 2, "F").count() == 7


def test_ranked_group_means_min_count(spark):
    data = [("A", float(i)) for i in range(9)] + [("A", None)] + [("B", 1.0)] * 9 + [("Other", 5.0)] * 12 \
        + [(None, 9.0)] * 11
    df = spark.createDataFrame(data, "loc string, speed double")
    assert explore.ranked_group_means(df, "loc", "speed", 10, exclude="Other").count() == 0
    df2 = df.union(spark.createDataFrame([("A", 3.0)], "loc string, speed double"))
    assert rows(explore.ranked_group_means(df2, "loc", "speed", 10, exclude="Other"), "loc", "count") == [("A", 10)]


def test_value_counts_top(spark):
    df = spark.createDataFrame([(x,) for x in [1, 1, 2, 3, 3, 3, None]], "y int")
    assert rows(explore.value_counts(df, "y", top=2)) == [(3, 3), (1, 2)]


@pytest.fixture()
def quart(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")


def test_iqr_and_limits(quart):
    r = stats.iqr(quart, "x").first()
    assert r["iqr"] == pytest.approx(1.5)
    lim = stats.mean_iqr_limits(quart, "x").first()
    assert (lim["lower_limit"], lim["upper_limit"]) == (pytest.approx(-0.5), pytest.approx(5.5))
    z = stats.zscore_limits(quart, "x").first()
    sd = np.std([1, 2, 3, 4], ddof=1)
    assert z["upper_limit"] == pytest.approx(2.5 + 2 * sd)


def test_histogram_edges_and_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "x double")
    h = charts.histogram(df, "x", 5).orderBy("bin")
    assert rows(h, "n") == [(2,), (1,), (0,), (0,), (1,)]
    np_counts, _ = np.histogram([0, 1, 2, 10], bins=5)
    assert [r[0] for r in rows(h, "n")] == list(np_counts)


def test_histogram_matches_numpy_on_data(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    vals = [r[0] for r in ev.select("value").collect()]
    np_counts, np_edges = np.histogram(vals, bins=30)
    h = charts.histogram(ev, "value", 30).orderBy("bin").collect()
    assert [r["n"] for r in h] == list(np_counts)
    assert [r["lo"] for r in h] == pytest.approx(list(np_edges[:-1]))


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    r = charts.box_stats(df, ["x"]).first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (1.0, 4.0, 1)


def test_least_squares_and_corr(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 4.0)], "x double, y double")
    r = stats.least_squares(df, "y", "x").first()
    assert r["slope"] == pytest.approx(1.5) and r["intercept"] == pytest.approx(-1 / 3)
    cm = {(a, b): c for a, b, c in rows(stats.corr_matrix(df, ["x", "y"]))}
    assert cm[("x", "y")] == pytest.approx(0.98198, abs=1e-5) and cm[("x", "x")] == 1.0 and len(cm) == 4


def test_kde_matches_numpy(spark):
    vals = [1.0, 2.0, 2.0, 3.5, 7.0, 8.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = charts.kde(df, "x", gridsize=50).orderBy("grid_index").collect()
    a = np.array(vals)
    bw = a.std(ddof=1) * len(a) ** (-0.2)
    grid = np.linspace(a.min(), a.max(), 50)
    dens = np.exp(-0.5 * ((grid[:, None] - a[None, :]) / bw) ** 2).sum(1) / (len(a) * bw * math.sqrt(2 * math.pi))
    assert [r["x"] for r in got] == pytest.approx(list(grid))
    assert [r["density"] for r in got] == pytest.approx(list(dens))


def test_boxcox_profile_matches_numpy(spark):
    vals = [0.5, 1.0, 2.0, 3.0, 8.0, 13.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = dict(rows(stats.boxcox_profile(df, "x", [-1.0, 0.0, 0.5])))
    a = np.array(vals)
    for lam in (-1.0, 0.0, 0.5):
        y = np.log(a) if lam == 0 else (a ** lam - 1) / lam
        llf = -len(a) / 2 * np.log(y.var()) + (lam - 1) * np.log(a).sum()
        assert got[lam] == pytest.approx(llf)


def test_ecdf_ends_at_one(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e = charts.ecdf(ev, "value", 50).orderBy("bin").collect()
    assert e[-1]["cum_n"] == ev.count() and e[-1]["cum_share"] == pytest.approx(1.0)


def test_poisson_bootstrap_interval_brackets_mean(spark):
    from quarry.operators.resampling import bootstrap_ci
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    r = bootstrap_ci(ev, "value", "event_id", replicates=50).first()
    assert r["ci_low"] < r["estimate"] < r["ci_high"] and r["replicates"] == 50
    again = bootstrap_ci(ev, "value", "event_id", replicates=50).first()
    assert (again["ci_low"], again["ci_high"]) == (r["ci_low"], r["ci_high"])      # deterministic weights


def test_rfm_scores_agree_with_the_built_in_window(spark):
    from pyspark.sql import Window
    from quarry.sources.views import sales
    base = rfm.rfm_base(sales(spark, "/root/testdata/sf0.001"))
    a = rfm.rfm_scores(base.repartition(5)).select("customername", "rfm_cell_string")
    tile = lambda c: F.ntile(4).over(Window.orderBy(c, "customername")).cast("string")
    b = base.select("customername", F.concat(tile("recency"), tile("frequency"), tile("monetary_value")).alias("b"))
    j = a.join(b, "customername")
    assert j.count() == a.count() == 150
    assert j.where(F.col("rfm_cell_string") != F.col("b")).count() == 0


def test_segmented_running_total_with_hot_key(spark):
    # key 0 holds a third of all rows, each with its own order value; NULLs and peers included
    df = spark.range(0, 3000).select(
        (F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17)).alias("k"),
        (F.col("id") / 2).cast("long").alias("o"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 5).cast("long").alias("v"))
    from pyspark.sql import Window
    ref = df.withColumn("r", F.sum("v").over(Window.partitionBy("k").orderBy("o")))
    got = rolling.running_total(df, ["k"], "o", "v", "r2", segmented=True, num_buckets=7)
    j = got.join(ref, ["k", "o", "v"])
    assert got.count() == 3000
    assert j.where(~F.col("r").eqNullSafe(F.col("r2"))).count() == 0


def test_scalar_helpers(spark):
    from pyspark.errors import PySparkException
    from quarry.functions.scalar import to_decimal, to_number_lenient, to_timestamp_lenient
    df = spark.createDataFrame([("12.345", "2020-01-02 03:04:05"), ("x1", "not a date")], "n string, t string")
    lenient = df.select("n", to_number_lenient("n").alias("x"), to_timestamp_lenient("t").alias("ts"))
    got = {r["n"]: r for r in lenient.collect()}
    assert got["12.345"]["x"] == 12.345 and got["12.345"]["ts"].day == 2
    assert got["x1"]["x"] is None and got["x1"]["ts"] is None
    assert str(df.where("n = '12.345'").select(to_decimal("n")).first()[0]) == "12.35"
    with pytest.raises(PySparkException):
        df.select(to_decimal("n")).collect()           # strict, as convert() fails on bad text


def test_scale_conf_sizes_partitions():
    from quarry.session import scale_conf
    c = scale_conf(100 * 2 ** 40)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2 ** 40 // (256 << 20)
    assert int(scale_conf(10)["spark.sql.shuffle.partitions"]) == 200


def test_bootstrap_corr_interval(spark):
    from quarry.operators.resampling import bootstrap_corr_ci
    from quarry.sources.views import coasters
    c = coasters(spark, "/root/testdata/sf0.01")
    r = bootstrap_corr_ci(c, "speed_mph", "height_ft", "row_id", replicates=60).first()
    ref = c.select(F.corr("speed_mph", "height_ft")).first()[0]
    assert r["estimate"] == pytest.approx(ref) and r["ci_low"] <= r["estimate"] <= r["ci_high"]
    assert -1 <= r["ci_low"] <= r["ci_high"] <= 1 and r["replicates"] == 60


def test_quantiles_read_only_their_columns_and_collapse_hot_values(spark):
    from quarry.operators.rank import exact_quantiles
    df = spark.range(0, 20000).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("v"),
        F.lit("unused").alias("u"))
    got = {r.g: (r.a, r.b) for r in exact_quantiles(df, "v", {"a": 0.5, "b": 0.9}, ["g"], num_buckets=8).collect()}
    ref = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    assert got.keys() == ref.keys() and all(got[g] == pytest.approx(ref[g], rel=1e-12) for g in ref)


def test_pair_grid_leaves_nulls_out_and_mirrors(spark):
    df = spark.createDataFrame([(0.0, 1.0, "a"), (None, 2.0, "a"), (4.0, None, "a"), (4.0, 2.0, "a")], "x double, y double, h string")
    got = {(r["var_x"], r["var_y"], r["bin_x"], r["bin_y"]): r["n"] for r in charts.pair_grid(df, ["x", "y"], "h", 2).collect()}
    assert got == {("x", "x", 0, 0): 1, ("x", "x", 1, 1): 2, ("y", "y", 0, 0): 1, ("y", "y", 1, 1): 2,
                   ("x", "y", 0, 0): 1, ("x", "y", 1, 1): 1, ("y", "x", 0, 0): 1, ("y", "x", 1, 1): 1}


@pytest.mark.parametrize("values", [[0.0] * 40 + [1.0, 2.5, 1000.0], list(np.linspace(-3, 3, 101) ** 3)])
def test_kde_by_boxes_equals_the_direct_sum(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    v = np.array(values)
    bw = v.std(ddof=1) * len(v) ** -0.2
    for r in charts.kde(df, "x", gridsize=60, pad_range=0.5).collect():
        direct = np.exp(-0.5 * ((r["x"] - v) / bw) ** 2).sum() / (len(v) * bw * np.sqrt(2 * np.pi))
        assert abs(r["density"] - direct) < 1e-14 / bw


def test_order_code_lists_in_one_pass(spark):
    df = spark.createDataFrame([(1, 9, "F"), (1, 3, "F"), (2, 5, "F"), (2, 4, "O"), (3, 1, "O"), (4, 7, "F"), (4, 7, "F"), (4, 2, "O")],
                               "ordernumber long, productcode long, status string")
    got = {r["ordernumber"]: r["product_codes"] for r in basket.order_code_lists(df, 2).collect()}
    assert got == {1: "3,9", 2: None, 3: None, 4: "2,7,7"}


def test_recurring_sets_of_any_size_equal_brute_force(spark):
    import itertools
    import random

    from quarry.operators import basket
    rng = random.Random(1)
    orders = {k: set(rng.sample(range(9), rng.randint(1, 6))) for k in range(60)}
    rows = [(k, c) for k, codes in orders.items() for c in codes] + [(0, c) for c in orders[0]] + [(99, None)]
    frame = spark.createDataFrame(rows, "ordernumber long, productcode long")
    counts = {}
    for codes in orders.values():
        for n in range(1, len(codes) + 1):
            for s in itertools.combinations(sorted(codes), n):
                counts[s] = counts.get(s, 0) + 1
    often = {s: n for s, n in counts.items() if n >= 5}
    got = {r.product_codes: (r.n_codes, r.n_orders, r.support) for r in basket.recurring_sets(frame, 5).collect()}
    assert got == {",".join(map(str, s)): (len(s), n, n / 60) for s, n in often.items() if len(s) > 1}
    assert max(v[0] for v in got.values()) >= 3
    rules = {(r.antecedent, r.consequent): (r.confidence, r.lift) for r in basket.product_rules(frame, 5).collect()}
    expected = {}
    for s, n in often.items():
        for c in s if len(s) > 1 else ():
            rest = tuple(x for x in s if x != c)
            expected[",".join(map(str, rest)), c] = (n / often[rest], n / often[rest] / (often[(c,)] / 60))
    assert rules.keys() == expected.keys() and all(v == pytest.approx(expected[k]) for k, v in rules.items())
    assert basket.recurring_sets(frame.limit(0)).count() == 0


def test_product_rules_need_the_least_orders_and_weigh_equal_baskets(spark):
    one = spark.createDataFrame([(1, 5), (1, 6)], "ordernumber long, productcode long")
    assert basket.product_rules(one).count() == 0            # one order cannot make a set recur
    rows = [(k, c) for k in range(40) for c in (1, 2, 3)] + [(100, 1), (100, 2), (None, 2), (None, 3), (None, 3), (101, 9)]
    frame = spark.createDataFrame(rows, "ordernumber long, productcode long")
    out = basket.product_rules(frame, 41)
    got = {(r.antecedent, r.consequent): (r.confidence, r.lift, r.support) for r in out.collect()}
    orders = 43                                              # the lines without an order are one order
    n = {1: 41, 2: 42, 3: 41}
    expected = {(str(a), c): (41 / n[a], 41 / n[a] / (n[c] / orders), 41 / orders)
                for a, c in ((1, 2), (2, 1), (2, 3), (3, 2))}
    assert got.keys() == expected.keys() and all(v == pytest.approx(expected[k]) for k, v in got.items())
    assert dict(out.dtypes) == {"antecedent": "string", "consequent": "bigint", "confidence": "double", "lift": "double", "support": "double"}


def test_recurring_sets_stay_out_of_the_driver_and_take_any_code(spark):
    rows = [(k, c) for k in range(6) for c in ("b", "a", "Z")[:1 + k % 3]] + [(50, f"c{i}") for i in range(300)] + [(51, "c7")]
    out = basket.recurring_sets(spark.createDataFrame(rows, "ordernumber long, productcode string"), 2, sep="|")
    assert {tuple(r)[:3] for r in out.collect()} == {("a|b", 2, 4), ("Z|b", 2, 2), ("Z|a", 2, 2), ("Z|a|b", 3, 2)}
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()      # no frame made of a model's rows


@pytest.mark.parametrize("at_once, short", [(8, 16), (0, 16), (0, 2), (1e9, 2)])
def test_recurring_sets_are_the_same_by_levels_and_at_once(spark, monkeypatch, at_once, short):
    import itertools
    import random
    monkeypatch.setattr(basket, "AT_ONCE", at_once)
    monkeypatch.setattr(basket, "SHORT_BASKET", short)
    rng = random.Random(7)
    orders = [sorted(rng.sample(range(8), rng.randint(1, 6))) for _ in range(40)] + [[*range(20, 26), 90 + k] for k in range(3)]
    frame = spark.createDataFrame([(k, c) for k, codes in enumerate(orders) for c in codes], "ordernumber long, productcode long")
    counts = {}
    for codes in orders:
        for n in range(2, len(codes) + 1):
            for s in itertools.combinations(codes, n):
                counts[",".join(map(str, s))] = counts.get(",".join(map(str, s)), 0) + 1
    got = basket.recurring_sets(frame, 3).collect()
    assert len({r.product_codes for r in got}) == len(got)
    assert {r.product_codes: r.n_orders for r in got} == {s: n for s, n in counts.items() if n >= 3}


def test_recurring_sets_of_a_long_order_need_few_steps(spark, monkeypatch):
    steps, stored = [], basket._stored
    monkeypatch.setattr(basket, "_stored", lambda df, name: (steps.append(name), stored(df, name))[1])
    frame = spark.createDataFrame([(k, c) for k in range(2) for c in range(9)], "ordernumber long, productcode long")
    assert basket.recurring_sets(frame).count() == 2 ** 9 - 9 - 1
    assert len(steps) <= 8                                   # two a size made 20 of them
