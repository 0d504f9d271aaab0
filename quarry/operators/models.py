"""Distributed models declared in the reference's README.

* ``model_comparison``: the linear families of ``gram`` (one moment matrix) and Spark ML's
  tree, factorization, isotonic and generalised linear regressors, on the same rows.
* ``gamma_glm``: predictions of ``gram.fit_gamma``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import compare_linear, fit_gamma, linear_families


def hash_uniform(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) with 52 bits, fixed by the (whole-number or text) values and the seed.

    The leading 13 hex digits of the md5 of the values joined by ``|``: any engine can repeat it.
    """
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _held_out(key: str, seed: int, test_share: float) -> Column:
    return hash_uniform(F.col(key), seed=seed) < test_share


# Rows of one task in the iterative fits.
TASK_ROWS = 50_000


def _spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt out evenly, ``task_rows`` a task, where there are more.

    Narrow tables lie in few and small files, whose tasks would keep most cores idle in every
    iteration of every fit. The number of tasks follows from the rows, not from the cluster.
    """
    tasks = -(-df.count() // task_rows)
    return df.repartition(tasks) if tasks > 1 else df


def _assemble(df: DataFrame, label: str, features: Sequence[str], key: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    clean = df.select(key, *features, label).na.drop("any")
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(clean) \
        .select(key, "features", *features, F.col(label).cast("double").alias("label"))


def _scores(pred: DataFrame) -> list[Column]:
    """RMSE, MAE and R² of (label, prediction) rows, as aggregates of one pass."""
    miss = F.col("label") - F.col("prediction")
    return [F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"),
            (1 - F.try_divide(F.avg(miss * miss), F.var_pop("label"))).alias("r2"), F.count(F.lit(1)).alias("n")]


def _regressors(seed: int):
    from pyspark.ml.regression import (DecisionTreeRegressor, FMRegressor, GBTRegressor,
                                       GeneralizedLinearRegression, IsotonicRegression, RandomForestRegressor)
    return [
        ("glm_gaussian", GeneralizedLinearRegression(family="gaussian", link="identity")),
        ("glm_gamma_log", GeneralizedLinearRegression(family="gamma", link="log")),
        ("glm_poisson_log", GeneralizedLinearRegression(family="poisson", link="log")),
        ("isotonic_first_feature", IsotonicRegression(featureIndex=0)),
        ("decision_tree", DecisionTreeRegressor(maxDepth=5, seed=seed)),
        ("random_forest", RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed)),
        ("gbt", GBTRegressor(maxIter=20, maxDepth=3, seed=seed)),
        ("factorization_machine", FMRegressor(factorSize=2, maxIter=50, seed=seed)),
    ]


def model_comparison(df: DataFrame, label: str, features: Sequence[str], key: str, seed: int = 7,
                     test_share: float = 0.2) -> DataFrame:
    """Fit each model on the same training rows; score RMSE, MAE, R² on held-out rows.

    The split is a hash of the row key, so it is the same on every run and partitioning.
    Returns one row per model: (model, rmse, mae, r2, n_train, n_test).
    """
    data = _spread(_assemble(df, label, features, key)).withColumn("_test", _held_out(key, seed, test_share)).persist()
    train, test = data.where(~F.col("_test")), data.where(F.col("_test"))
    n_train = train.count()
    plain = data.select(F.col("label"), *[F.col(f).cast("double").alias(f) for f in features], "_test")
    rows = compare_linear(plain, "label", features, "_test")
    for name, est in _regressors(seed):
        pred = est.fit(train).transform(test)
        got = pred.agg(*_scores(pred)).first()
        rows.append((name, got["rmse"], got["mae"], got["r2"], n_train, got["n"]))
    data.unpersist()
    spark = df.sparkSession
    return spark.createDataFrame(rows, "model string, rmse double, mae double, r2 double, n_train long, n_test long")


def linear_holdout(df: DataFrame, label: str, feature: str, key: str, seed: int = 7,
                   test_share: float = 0.2) -> DataFrame:
    """One linear model on one feature, scored like ``model_comparison``:
    (slope, intercept, rmse, mae, r2, n_train, n_test), one row."""
    from pyspark.ml.regression import LinearRegression
    data = _assemble(df, label, [feature], key).withColumn("_test", _held_out(key, seed, test_share)).persist()
    train, test = data.where(~F.col("_test")), data.where(F.col("_test"))
    model = LinearRegression(solver="normal").fit(train)
    n_train = train.count()
    pred = model.transform(test)
    return pred.agg(*_scores(pred)).select(
        F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept"),
        "rmse", "mae", "r2", F.lit(n_train).cast("long").alias("n_train"), F.col("n").alias("n_test"))


def positive_rows(df: DataFrame, label: str, features: Sequence[str], *keep: str) -> DataFrame:
    """The complete rows with a positive label, as doubles."""
    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in [*features, label] if c not in keep])
    return rows.na.drop("any").where(F.col(label) > 0)


def gamma_glm(df: DataFrame, label: str, features: Sequence[str], key: str) -> DataFrame:
    """Gamma regression with log link; predictions for every complete row: (key, label, prediction)."""
    rows = positive_rows(df, label, features, key)
    return rows.select(key, label, fit_gamma(rows, label, features).predicted().alias("prediction"))


def compare_families(df: DataFrame, label: str, features: Sequence[str], key: str, names: Sequence[str], seed: int = 7,
                     test_share: float = 0.2) -> DataFrame:
    """The linear families called ``names`` scored like ``model_comparison``: (model, rmse, mae, r2, n_train, n_test)."""
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in [*features, label]]).na.drop("any")
    rows = rows.withColumn("_test", _held_out(key, seed, test_share))
    every = linear_families(features)
    out = compare_linear(rows, label, features, "_test", {n: every[n] for n in names})
    return df.sparkSession.createDataFrame(out, "model string, rmse double, mae double, r2 double, n_train long, n_test long")
