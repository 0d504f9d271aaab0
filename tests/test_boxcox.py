"""Box-Cox likelihoods from boxes of logarithms against the values themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quarry.operators import boxcox


def _llf(a, lam):
    y = np.log(a) if lam == 0 else np.expm1(lam * np.log(a)) / lam
    return -len(a) / 2 * np.log(y.var()) + (lam - 1) * np.log(a).sum()


@pytest.fixture(scope="module")
def skewed(spark):
    a = np.random.default_rng(5).gamma(2.0, 3.0, 4000)
    return a, spark.createDataFrame([(float(v),) for v in a], "x double")


def test_profile_equals_the_values_at_every_lambda(spark, skewed):
    a, df = skewed
    lams = [-8.0, -2.0, -0.3, -1e-7, 0.0, 1e-9, 0.5, 1.0, 2.0, 8.0]
    for lam, got in rows(boxcox.boxcox_profile(df, "x", lams)):
        assert got == pytest.approx(_llf(a, lam), rel=1e-9)


def test_near_equal_large_values_do_not_cancel(spark):
    a = 1e9 + np.arange(50.0)
    df = spark.createDataFrame([(float(v),) for v in a], "x double")
    got = dict(rows(boxcox.boxcox_profile(df, "x", [0.0, 1.0])))
    assert got[1.0] == pytest.approx(-25 * math.log(a.var()), rel=1e-6)


def test_fit_is_the_top_and_its_interval_drops_as_asked(spark, skewed):
    a, df = skewed
    n, lam, llf, low, high = rows(boxcox.boxcox_fit(df, "x"))[0]
    assert n == len(a) and low < lam < high and llf == pytest.approx(_llf(a, lam), rel=1e-10)
    assert all(_llf(a, lam) >= _llf(a, lam + d) for d in (-1e-3, 1e-3))
    for end in (low, high):
        assert _llf(a, lam) - _llf(a, end) == pytest.approx(1.920729410347062, abs=1e-6)


def test_lognormal_values_need_the_logarithm_and_powers_are_found(spark):
    z = np.random.default_rng(9).normal(3.0, 0.4, 5000)
    frame = spark.createDataFrame([(float(math.exp(v)), float(max(v, 0.1) ** 4)) for v in z], "l double, p double")
    assert abs(rows(boxcox.boxcox_fit(frame, "l"))[0][1]) < 0.15
    assert rows(boxcox.boxcox_fit(frame, "p"))[0][1] == pytest.approx(0.25, abs=0.1)


def test_values_without_a_likelihood(spark):
    schema = "x double"
    assert rows(boxcox.boxcox_fit(spark.createDataFrame([], schema), "x")) == [(0, None, None, None, None)]
    bad = [(None,), (0.0,), (-3.0,), (float("nan"),), (float("inf"),)]
    assert rows(boxcox.boxcox_fit(spark.createDataFrame(bad, schema), "x"))[0][0] == 0
    alike = spark.createDataFrame([(7.0,)] * 5 + bad, schema)
    assert rows(boxcox.boxcox_fit(alike, "x")) == [(5, None, None, None, None)]
    assert rows(boxcox.boxcox_profile(alike, "x", [0.5])) == [(0.5, None)]


def test_boxes_are_bounded_and_the_series_is_tight(spark):
    wide = spark.range(20000).select(F.exp((F.col("id") / 20000) * 1400 - 700).alias("x"))
    boxes = boxcox.log_boxes(wide, "x")
    assert boxes.count() <= 11642
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    assert boxcox.series_error(2.0) < 1e-15 and boxcox.series_error(8.0) < 1e-8
