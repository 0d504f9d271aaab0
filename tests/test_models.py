"""Linear families from the moment matrix, gamma regression, resampling: numpy and library versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import gram, models, resampling

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 3)) * [1.0, 30.0, 0.2] + [2000.0, 0.0, 5.0]
    x[:, 1] += 20 * x[:, 0]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.standard_normal(400) + 100
    rows = [(k, *map(float, x[k]), float(y[k]), k % 4 == 0) for k in range(400)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y double, held boolean").repartition(3), x, y


def standardised(x, y):
    z = (x - x.mean(0)) / x.std(0)
    return z, y - y.mean()


def test_families_equal_numpy(table):
    df, x, y = table
    m = gram.moments(df, [*FEATURES, "y"], "held")[False]
    keep = np.arange(400) % 4 != 0
    z, t = standardised(x[keep], y[keep])
    n, sd = len(z), x[keep].std(0)
    ols = np.linalg.lstsq(z, t, rcond=None)[0]
    assert np.allclose(gram.ridge(m, 0).slopes * sd, ols, rtol=1e-7)
    assert np.allclose(gram.ridge(m, 0.3).slopes * sd, np.linalg.solve(z.T @ z / n + 0.3 * np.eye(3), z.T @ t / n), rtol=1e-7)
    assert np.allclose(gram.principal_components(m, 3).slopes, gram.ridge(m, 0).slopes) and np.allclose(
        gram.partial_least_squares(m, 3).slopes, gram.ridge(m, 0).slopes)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(gram.principal_components(m, 1).slopes * sd, v[0] * (u[:, 0] @ t) / s[0], rtol=1e-7)
    w = z.T @ t
    score = z @ w
    assert np.allclose(gram.partial_least_squares(m, 1).slopes * sd, w * (score @ t) / (score @ score), rtol=1e-7)
    for share in (1.0, 0.4):        # the conditions of the optimum
        b = gram.elastic_net(m, 0.1, share).slopes * sd
        slope = z.T @ (t - z @ b) / n - 0.1 * (1 - share) * b
        assert all(abs(g) <= 0.1 * share * t.std() + 1e-8 if not c else g == pytest.approx(math.copysign(0.1 * share * t.std(), c), abs=1e-8)
                   for g, c in zip(slope, b))
    assert np.allclose(gram.best_subset(m, 0.0).slopes, gram.ridge(m, 0).slopes)
    assert gram.forward(m, 1e9).slopes.tolist() == gram.backward(m, 1e9).slopes.tolist() == [0, 0, 0]


def test_scores_come_from_moments(table):
    df, x, y = table
    held, found = np.arange(400) % 4 == 0, gram.compare_linear(df, "y", FEATURES, "held")
    assert len(found) >= 18 and len({r[0] for r in found}) == len(found)
    z = np.column_stack([np.ones(400), x - x.mean(0)])
    beta = np.linalg.lstsq(z[~held], y[~held], rcond=None)[0]
    miss = y[held] - z[held] @ beta
    got = next(r for r in found if r[0] == "least_squares")
    assert got[1:] == (pytest.approx(math.sqrt((miss**2).mean())), pytest.approx(np.abs(miss).mean()),
                       pytest.approx(1 - (miss**2).mean() / y[held].var()), 300, 100)
    assert gram.compare_linear(df.where("held"), "y", FEATURES, "held") == []


def test_linear_families_read_the_data_once_to_fit(spark, table):
    df, _, _ = table
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    gram.compare_linear(df, "y", FEATURES, "held")
    jobs = len(tracker.getJobIdsForGroup("fit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8          # two aggregates (the adaptive plan runs each shuffle stage as a job)


def test_model_comparison_has_twenty_families(spark, table):
    df, _, _ = table
    out = models.model_comparison(df.withColumn("y", F.abs("y") + 1), "y", FEATURES, "k").collect()
    assert len({r.model for r in out}) >= 20 and all(r.n_train + r.n_test == 400 for r in out)


def test_gamma_regression_equals_the_library(spark, table):
    df, _, _ = table
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    pos = df.withColumn("z", F.col("a") - 2000).select("k", "z", "c", (F.exp(0.3 * (F.col("a") - 2000) + 0.1 * F.col("c")) * (1 + F.col("k") % 7)).alias("y"))
    fit = gram.fit_gamma(pos, "y", ["z", "c"])
    data = VectorAssembler(inputCols=["z", "c"], outputCol="features").transform(pos)
    lib = GeneralizedLinearRegression(family="gamma", link="log", labelCol="y", tol=1e-12, maxIter=100).fit(data)
    assert np.allclose(fit.estimate, [lib.intercept, *lib.coefficients], rtol=1e-6)
    errors = lib.summary.coefficientStandardErrors
    assert np.allclose(fit.std_error, [errors[-1], *errors[:-1]], rtol=1e-5)
    assert fit.deviance == pytest.approx(lib.summary.deviance) and fit.null_deviance == pytest.approx(lib.summary.nullDeviance)
    assert fit.dispersion == pytest.approx(lib.summary.dispersion)
    with pytest.raises(ValueError):
        gram.fit_gamma(pos.limit(2), "y", ["z", "c"])


def test_replicates_equal_brute_force(spark):
    rows = [(k, float(k % 11), float(k * k % 17)) for k in range(500)] + [(900, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    cdf = resampling.poisson1_cdf()

    def weight(k, b):
        digest = hashlib.md5(f"{k}|{b // 4}|7".encode()).hexdigest()
        u = int(digest[8 * (b % 4):8 * (b % 4) + 8], 16) / 2**32
        return next(w for w, c in enumerate(cdf) if u < c)
    got = {r.replicate: (r.w, r.x) for r in resampling.replicate_sums(df, "k", {"x": F.col("x")}, 10, 7).collect()}
    for b in range(10):
        w = [weight(k, b) for k, _, _ in rows[:500]]
        assert got[b + 1] == (sum(w), sum(a * r[1] for a, r in zip(w, rows)))
    plan = resampling.bootstrap_ci(df, "x", "k")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    band = resampling.regression_band(df, "y", "x", "k", points=5, replicates=40).orderBy("grid_index").collect()
    assert len(band) == 5 and all(r.lower <= r.fitted <= r.upper for r in band)
    assert resampling.bootstrap_ci(df.limit(0), "x", "k").first().ci_low is None


def test_rows_of_one_file_are_dealt_out_to_fit(spark):
    df = spark.range(0, 1050, numPartitions=1).select("id", (F.col("id") % 7).cast("double").alias("y"))
    out = models._spread(df, 100)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 11 and max(sizes) <= 100 and sum(sizes) == 1050
    assert out.exceptAll(df).isEmpty() and models._spread(df, 1050) is df
