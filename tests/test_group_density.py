"""Density curves per group against numpy."""

import math

import numpy as np
import pytest

from quarry.operators import charts


def _curve(a, gridsize, cut, share):
    bw = a.std(ddof=1) * len(a) ** -0.2
    x = np.linspace(a.min() - cut * bw, a.max() + cut * bw, gridsize)
    return x, share * np.exp(-0.5 * ((x[:, None] - a) / bw) ** 2).sum(1) / (len(a) * bw * math.sqrt(2 * math.pi))


def _frame(spark, groups):
    return spark.createDataFrame([("c", g, float(v)) for g, a in groups.items() for v in a]
                                 + [("c", None, 5.0), ("c", "a", None), (None, "a", 1.0)], "col string, g string, v double")


def test_every_group_has_its_own_bandwidth_and_grid(spark):
    r = np.random.default_rng(1)
    groups = {"a": r.normal(0, 1, 300), "b": r.gamma(2, 50, 40), "it's": r.normal(1e6, 2, 10)}
    n = sum(map(len, groups.values()))
    for common in (True, False):
        got = charts.group_density(_frame(spark, groups), "v", ["col"], "g", gridsize=30, common_norm=common).collect()
        assert len(got) == 90
        for g, a in groups.items():
            mine = sorted((r.grid_index, r.x, r.density) for r in got if r.g == g)
            x, dens = _curve(a, 30, 3.0, len(a) / n if common else 1.0)
            assert [m[1] for m in mine] == pytest.approx(list(x))
            assert [m[2] for m in mine] == pytest.approx(list(dens), rel=1e-8, abs=1e-15)


def test_groups_without_spread_have_no_curve_but_keep_their_share(spark):
    groups = {"one": np.array([3.0]), "alike": np.array([4.0] * 9), "wide": np.array([1.0, 2.0, 4.0, 8.0] * 5)}
    got = charts.group_density(_frame(spark, groups), "v", ["col"], "g", gridsize=20).orderBy("grid_index").collect()
    assert {r.g for r in got} == {"wide"}
    assert [r.density for r in got] == pytest.approx(list(_curve(groups["wide"], 20, 3.0, 20 / 30)[1]))
    assert charts.group_density(_frame(spark, {}).where("false"), "v", ["col"], "g").count() == 0


def test_values_are_reduced_per_group_before_the_grid(spark):
    df = _frame(spark, {"a": np.arange(50.0), "b": np.arange(20.0)})
    plan = charts.group_density(df, "v", ["col"], "g")._jdf.queryExecution().optimizedPlan().toString()
    # from the top: the grid points, then box moments, then the values with their group's numbers
    grid, join = plan.index("Generate explode"), plan.index("Join Inner")
    assert grid < join and "Aggregate [" in plan[grid:join] and "Join Cross" not in plan
