"""Exhaustive / randomised checks of the arithmetic behind ntile and histogram bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import charts
from quarry.operators.rank import ntile_from_rank


def _ntile_reference(n, k):
    # SQL ntile: the first n % k tiles get one extra row
    q, r = divmod(n, k)
    out = []
    for tile in range(1, k + 1):
        out += [tile] * (q + (1 if tile <= r else 0))
    return out[:n]


def test_ntile_formula_exhaustive(spark):
    rows = [(k, n, rn) for k in range(1, 8) for n in range(1, 61) for rn in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k int, n long, rn long")
    got = {}
    for k in range(1, 8):
        part = df.where(F.col("k") == k).select("n", "rn", ntile_from_rank(F.col("rn"), F.col("n"), k).alias("t"))
        for n, rn, t in part.collect():
            got[(k, n, rn)] = t
    for k in range(1, 8):
        for n in range(1, 61):
            assert [got[(k, n, rn)] for rn in range(1, n + 1)] == _ntile_reference(n, k)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_bins_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 40))
    kind = seed % 3
    if kind == 0:
        vals = rng.normal(size=500).round(2)          # many ties, values on edges
    elif kind == 1:
        vals = rng.integers(0, 20, size=300).astype(float)
    else:
        vals = np.full(50, 3.25)                        # constant column: numpy's ±0.5 range
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    h = charts.histogram(df, "x", k).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=k)
    assert [r["n"] for r in h] == list(counts)
    assert [r["lo"] for r in h] == pytest.approx(list(edges[:-1]))
    assert [r["hi"] for r in h] == pytest.approx(list(edges[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_fd_bins_match_numpy_rule(spark, seed):
    rng = np.random.default_rng(seed)
    vals = rng.gamma(2.0, 3.0, size=int(rng.integers(20, 400)))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    q75, q25 = np.percentile(vals, [75, 25])
    h = 2 * (q75 - q25) / (len(vals) ** (1 / 3))
    expected = min(int(np.ceil((vals.max() - vals.min()) / h)), 50)
    assert charts.fd_bins(df, "x", most=50) == expected
    const = spark.createDataFrame([(1.0,)] * 9, "x double")
    assert charts.fd_bins(const, "x", most=50) == 3                    # IQR 0: sqrt(n) bins
