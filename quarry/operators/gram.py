"""Linear model families from one moment matrix (R4), and gamma regression with inference.

One aggregate gives, per split, the row count, the means and the covariances of all features
and the label (Spark's covariance merges without cancellation). Everything linear is then
solved on that p × p matrix on the driver: least squares, ridge, lasso and elastic net by
coordinate descent, principal-component and partial least squares, forward, backward and
best-subset selection. Squared errors on the held-out rows follow from their moments too;
absolute errors of all models take one more pass together.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Moments(NamedTuple):
    """Row count, means and (population) covariances of the columns, the label last."""
    n: int
    mean: np.ndarray
    cov: np.ndarray


class Line(NamedTuple):
    """A fitted linear model."""
    intercept: float
    slopes: np.ndarray


def moments(df: DataFrame, columns: Sequence[str], split: str) -> dict[bool, Moments]:
    """The moments of complete numeric ``columns`` on either side of the boolean column ``split``, in one pass."""
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    found = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                                  *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in found:
        cov = np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r[split]] = Moments(r.n, np.array([r[f"m{i}"] for i in range(p)]), cov)
    return out


def _standard(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(correlations of the features, their covariance with the label in units of their deviations, deviations, label variance)."""
    sd = np.sqrt(np.diag(m.cov)[:-1])
    sd = np.where(sd > 0, sd, 1.0)
    return m.cov[:-1, :-1] / np.outer(sd, sd), m.cov[:-1, -1] / sd, sd, m.cov[-1, -1]


def _line(m: Moments, beta: np.ndarray, sd: np.ndarray) -> Line:
    slopes = beta / sd
    return Line(float(m.mean[-1] - slopes @ m.mean[:-1]), slopes)


def ridge(m: Moments, penalty: float) -> Line:
    """min |y − Xb|² / 2n + penalty · |b|² / 2 on standardised features; penalty 0 is least squares."""
    r, c, sd, _ = _standard(m)
    return _line(m, np.linalg.lstsq(r + penalty * np.eye(len(c)), c, rcond=None)[0], sd)


def elastic_net(m: Moments, penalty: float, share: float, rounds: int = 10_000, tolerance: float = 1e-12) -> Line:
    """Coordinate descent for penalty · (share · |b|₁ + (1 − share) · |b|² / 2); share 1 is the lasso."""
    r, c, sd, var = _standard(m)
    b, scale = np.zeros(len(c)), math.sqrt(var) if var > 0 else 1.0
    for _ in range(rounds):
        before = b.copy()
        for j in range(len(b)):
            rest = c[j] - r[j] @ b + r[j, j] * b[j]
            shrunk = math.copysign(max(abs(rest) - penalty * share * scale, 0.0), rest)
            b[j] = shrunk / (r[j, j] + penalty * (1 - share)) if r[j, j] + penalty * (1 - share) > 0 else 0.0
        if np.abs(b - before).max(initial=0) <= tolerance * scale:
            break
    return _line(m, b, sd)


def principal_components(m: Moments, k: int) -> Line:
    """Least squares on the first ``k`` principal components of the standardised features."""
    r, c, sd, _ = _standard(m)
    values, vectors = np.linalg.eigh(r)
    keep = [j for j in np.argsort(-values)[:k] if values[j] > 1e-12]
    return _line(m, vectors[:, keep] @ (vectors[:, keep].T @ c / values[keep]), sd)


def partial_least_squares(m: Moments, k: int) -> Line:
    """Least squares in the Krylov space of (correlations, label covariances) with ``k`` directions."""
    r, c, sd, _ = _standard(m)
    space = np.zeros((len(c), 0))
    w = c.copy()
    for _ in range(min(k, len(c))):
        for _ in range(2):
            w = w - space @ (space.T @ w)
        if np.linalg.norm(w) <= 1e-12 * max(np.linalg.norm(c), 1e-300):
            break
        space = np.column_stack([space, w / np.linalg.norm(w)])
        w = r @ space[:, -1]
    if not space.shape[1]:
        return _line(m, np.zeros(len(c)), sd)
    return _line(m, space @ np.linalg.lstsq(space.T @ r @ space, space.T @ c, rcond=None)[0], sd)


def on_subset(m: Moments, chosen: Sequence[int]) -> Line:
    """Least squares on some of the features, the slopes of the others zero."""
    r, c, sd, _ = _standard(m)
    b, at = np.zeros(len(c)), list(chosen)
    if at:
        b[at] = np.linalg.lstsq(r[np.ix_(at, at)], c[at], rcond=None)[0]
    return _line(m, b, sd)


def _information(m: Moments, chosen: Sequence[int], price: float) -> float:
    """n ln(residual variance) + price per parameter."""
    return m.n * math.log(max(squared_error(m, on_subset(m, chosen)), 1e-300)) + price * (len(chosen) + 1)


def forward(m: Moments, price: float) -> Line:
    """Adds the feature that lowers the criterion most, as long as one does."""
    chosen, best = [], _information(m, [], price)
    while len(chosen) < len(m.mean) - 1:
        score, j = min((_information(m, [*chosen, j], price), j) for j in range(len(m.mean) - 1) if j not in chosen)
        if score >= best:
            break
        chosen, best = [*chosen, j], score
    return on_subset(m, chosen)


def backward(m: Moments, price: float) -> Line:
    """Drops the feature whose loss lowers the criterion most, as long as one does."""
    chosen = list(range(len(m.mean) - 1))
    best = _information(m, chosen, price)
    while chosen:
        score, j = min((_information(m, [i for i in chosen if i != j], price), j) for j in chosen)
        if score >= best:
            break
        chosen, best = [i for i in chosen if i != j], score
    return on_subset(m, chosen)


def best_subset(m: Moments, price: float, most: int = 12) -> Line:
    """The subset with the lowest criterion of all (at most ``most`` features: 2^most fits of a small matrix)."""
    p = len(m.mean) - 1
    if p > most:
        raise ValueError(f"best subset needs at most {most} features")
    every = itertools.chain.from_iterable(itertools.combinations(range(p), k) for k in range(p + 1))
    return on_subset(m, min(every, key=lambda s: (_information(m, s, price), s)))


def squared_error(m: Moments, line: Line) -> float:
    """Mean squared error of a line on the rows behind the moments."""
    b = line.slopes
    spread = m.cov[-1, -1] - 2 * b @ m.cov[:-1, -1] + b @ m.cov[:-1, :-1] @ b
    return float(max(spread, 0.0) + (m.mean[-1] - line.intercept - b @ m.mean[:-1]) ** 2)


def linear_families(features: Sequence[str]) -> dict[str, Callable[[Moments], Line]]:
    """Every linear family by name."""
    p = len(features)
    out: dict[str, Callable[[Moments], Line]] = {"mean": lambda m: on_subset(m, []), "least_squares": lambda m: ridge(m, 0.0)}
    out |= {f"ridge_{x:g}": lambda m, x=x: ridge(m, x) for x in (0.01, 0.1, 1.0)}
    out |= {f"lasso_{x:g}": lambda m, x=x: elastic_net(m, x, 1.0) for x in (0.01, 0.1, 0.5)}
    out |= {f"elastic_net_{s:g}": lambda m, s=s: elastic_net(m, 0.1, s) for s in (0.25, 0.5, 0.75)}
    out |= {f"principal_components_{k}": lambda m, k=k: principal_components(m, k) for k in range(1, p)}
    out |= {f"partial_least_squares_{k}": lambda m, k=k: partial_least_squares(m, k) for k in range(1, p)}
    out |= {"forward_aic": lambda m: forward(m, 2.0), "backward_aic": lambda m: backward(m, 2.0),
            "forward_bic": lambda m: forward(m, math.log(m.n)), "best_subset_bic": lambda m: best_subset(m, math.log(m.n))}
    out |= {f"only_{f}": lambda m, i=i: on_subset(m, [i]) for i, f in enumerate(features)}
    return out


def _predicted(line: Line, features: Sequence[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(f) for b, f in zip(line.slopes, features)), F.lit(line.intercept))


def compare_linear(data: DataFrame, label: str, features: Sequence[str], split: str,
                   families: dict[str, Callable[[Moments], Line]] | None = None) -> list[tuple]:
    """(model, rmse, mae, r2, n_train, n_test) of every family: fitted where ``split`` is false, scored where true.

    ``data`` holds complete doubles. Two aggregates whatever the number of models; empty
    when either side has no rows.
    """
    found = moments(data, [*features, label], split)
    if len(found) < 2:
        return []
    train, test = found[False], found[True]
    lines = {name: fit(train) for name, fit in (families or linear_families(features)).items()}
    misses = data.where(F.col(split)).agg(*[F.avg(F.abs(F.col(label) - _predicted(x, features))).alias(name)
                                            for name, x in lines.items()]).first()
    out = []
    for name, line in lines.items():
        mse = squared_error(test, line)
        out.append((name, math.sqrt(mse), misses[name], float(1 - mse / test.cov[-1, -1]) if test.cov[-1, -1] > 0 else None, train.n, test.n))
    return out


class GammaFit(NamedTuple):
    """Gamma regression with log link; terms are the intercept and the features, in units of the data."""
    terms: list[str]
    estimate: np.ndarray
    std_error: np.ndarray
    n: int
    deviance: float
    null_deviance: float
    dispersion: float
    iterations: int

    def predicted(self) -> Column:
        return F.exp(sum((F.lit(float(b)) * F.col(t) for b, t in zip(self.estimate[1:], self.terms[1:])), F.lit(float(self.estimate[0]))))


def fit_gamma(data: DataFrame, label: str, features: Sequence[str], rounds: int = 50, tolerance: float = 1e-11) -> GammaFit:
    """Iteratively reweighted least squares, one weighted moment aggregate an iteration.

    ``data`` holds complete doubles with a positive label. Features are standardised first.
    With the log link a gamma response has working weight 1, so the weighted Gram matrix is
    that of the features; each iteration aggregates its product with the working residual
    (y − μ) / μ. The dispersion is Pearson's; standard errors are its root times those of
    the inverse Gram matrix.
    """
    p = len(features)
    first = data.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("y"), F.avg(F.log(label)).alias("ly"),
                     *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
                     *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    n = first.n
    if n <= p + 1:
        raise ValueError("gamma regression needs more complete rows than terms")
    mean = np.array([first[f"m{i}"] for i in range(p)])
    sd = np.array([first[f"s{i}"] or 1.0 for i in range(p)])
    gram = np.zeros((p + 1, p + 1))
    gram[0, 0] = n
    for i in range(p):
        for j in range(i, p):
            gram[i + 1, j + 1] = gram[j + 1, i + 1] = n * first[f"c{i}_{j}"] / (sd[i] * sd[j])
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    z = [(F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, mean, sd)]
    beta, iterations = np.concatenate([[math.log(first.y)], np.zeros(p)]), 0
    while True:
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta[1:], z)), F.lit(float(beta[0])))
        rows = data.select(F.col(label).alias("y"), eta.alias("eta"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
        rows = rows.withColumn("w", F.col("y") / F.exp("eta") - 1)
        got = rows.agg(F.sum("w").alias("g0"), *[F.sum(F.col("w") * F.col(f"z{i}")).alias(f"g{i + 1}") for i in range(p)],
                       F.sum(F.col("w") * F.col("w")).alias("pearson"), F.sum(F.col("w") - F.log1p("w")).alias("half")).first()
        step = inverse @ np.array([got[f"g{i}"] for i in range(p + 1)])
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()) or iterations == rounds:
            break
        beta, iterations = beta + step, iterations + 1
    dispersion = got.pearson / (n - p - 1)
    back = np.zeros((p + 1, p + 1))             # from standardised terms to those of the data
    back[0, 0] = 1.0
    for i in range(p):
        back[i + 1, i + 1], back[0, i + 1] = 1 / sd[i], -mean[i] / sd[i]
    errors = np.sqrt(np.maximum(np.diag(back @ inverse @ back.T) * dispersion, 0.0))
    null = 2 * n * (math.log(first.y) - first.ly)
    return GammaFit(["intercept", *features], back @ beta, errors, n, 2 * got.half, null, dispersion, iterations)


def gamma_inference(data: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """One row per term: (term, estimate, std_error, t_value, score, n, deviance, null_deviance, dispersion).

    ``score`` is the mean of (y − μ) / μ times the term's value, 0 at the maximum of the
    likelihood; it is computed anew from the fitted coefficients.
    """
    fit = fit_gamma(data, label, features)
    miss = F.col(label) / fit.predicted() - 1
    score = data.agg(*[F.avg(miss * (F.lit(1.0) if t == "intercept" else F.col(t))).alias(t) for t in fit.terms]).first()
    rows = [(t, float(b), float(e), float(b / e) if e else None, float(score[t]), fit.n, fit.deviance, fit.null_deviance, fit.dispersion)
            for t, b, e in zip(fit.terms, fit.estimate, fit.std_error)]
    return data.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, score double, "
                                                   "n long, deviance double, null_deviance double, dispersion double")
