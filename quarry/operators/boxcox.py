"""Box-Cox power transforms from one pass over the values.

ln x falls into boxes of width 1/8 at fixed places (multiples of the width), and one
partial aggregate keeps per box the count and the power sums M_k = Σ d^k of the distances
d to the box's middle. The logarithm of a positive double lies in (-745.2, 709.8), so
there are at most 11,642 boxes whatever the data: this summary is what is read back.

With m a box's middle, (x^λ − 1)/λ = (e^(λm) − 1)/λ + e^(λm) q, q = (e^(λd) − 1)/λ, and

    Σ q  = Σ_(k≥1) λ^(k−1) M_k / k!          Σ q² = Σ_(k≥2) (2^k − 2) λ^(k−2) M_k / k!

hold for every λ, 0 included, without cancellation. The sum, variance and likelihood of the
transformed values thus follow for any λ from the boxes alone; ``series_error`` bounds what
the cut series leaves out. Values that are NULL, NaN, infinite or not positive take no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDTH, _TERMS = 0.125, 13
# half the 95 % point of chi-square with one degree of freedom
_DROP = 1.920729410347062
# no end of an interval is sought beyond
_FAR = 32.0


def boxcox_grid(lo: float = -2.0, hi: float = 2.0, step: float = 0.1) -> list[float]:
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 10) for i in range(n + 1)]


def boxcox_transform(x: Column, lam: Column) -> Column:
    """(x^λ − 1)/λ, or ln x at λ = 0; NULL for x that is not positive."""
    return F.when(x > 0, F.when(lam == 0, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam))


def boxcox_best(profile: DataFrame) -> Column:
    """The λ of the largest likelihood (ties: the smaller λ), as a scalar subquery."""
    return profile.select(F.max_by("lambda", F.struct("llf", -F.col("lambda")))).scalar()


def log_boxes(df: DataFrame, col: str, origin: float = 0.0) -> DataFrame:
    """(box, m0, …, m12): count and power sums of ln x around each box's middle; one partial aggregate.

    The middle is ``origin`` plus ``box`` widths.
    """
    x = F.col(col).cast("double")
    logs = df.select(x.alias("x")).where((F.col("x") > 0) & (F.col("x") < float("inf"))).select(F.log("x").alias("l"))
    away = F.col("l") - F.lit(float(origin))
    boxed = logs.withColumn("box", F.floor(away / _WIDTH + 0.5).cast("int")).withColumn("d", away - F.col("box") * _WIDTH)
    power, sums = F.lit(1.0), [F.count("*").cast("double").alias("m0")]
    for k in range(1, _TERMS):
        power = power * F.col("d")
        sums.append(F.sum(power).alias(f"m{k}"))
    return boxed.groupBy("box").agg(*sums)


def series_error(lam: float) -> float:
    """Bound of what the cut series leaves out of Σ q², as a share of Σ d²."""
    u = abs(lam) * _WIDTH
    return 4 * sum(u ** (k - 2) / math.factorial(k) for k in range(_TERMS, _TERMS + 40))


class BoxCox:
    """Likelihood of any λ of one column, from its boxes.

    Logarithms that lie within a thousandth of each other (standard deviation) are boxed once
    more with their mean as a middle: around a far middle their sums of squares would cancel.
    """

    def __init__(self, df: DataFrame, col: str):
        self._take(log_boxes(df, col), 0.0)
        if self.n and self._log_spread() < 1e-6:
            self._take(log_boxes(df, col, self.centre), self.centre)

    def _take(self, boxes: DataFrame, origin: float) -> None:
        rows = np.array([tuple(r) for r in boxes.orderBy("box").collect()], float).reshape(-1, _TERMS + 1)
        self.sums = rows[:, 1:].T
        middle = origin + rows[:, 0] * _WIDTH
        self.n = float(self.sums[0].sum())
        self.log_sum = float((middle * self.sums[0]).sum() + self.sums[1].sum())
        # seen from the mean logarithm, powers neither overflow nor dwarf the spread
        self.centre = self.log_sum / self.n if self.n else 0.0
        self.middle = middle - self.centre

    def _log_variance(self, lam):
        """ln of the population variance of the transformed values."""
        count, m = self.sums[0], self.middle
        grown = np.exp(lam * m)
        first = sum(lam ** (k - 1) * self.sums[k] / math.factorial(k) for k in range(1, _TERMS))
        second = sum((2 ** k - 2) * lam ** (k - 2) * self.sums[k] / math.factorial(k) for k in range(2, _TERMS))
        base = m if lam == 0 else np.expm1(lam * m) / lam
        mean = base + grown * first / count
        inside = grown * grown * (second - first * first / count)
        whole = (count * mean).sum() / self.n
        spread = (inside.sum() + (count * (mean - whole) * (mean - whole)).sum()) / self.n
        return np.log(spread) + 2 * lam * self.centre

    def likelihood(self, lam):
        """−n/2 · ln σ²_λ + (λ − 1) · Σ ln x: the normal profile log-likelihood."""
        return -self.n / 2 * self._log_variance(lam) + (lam - 1) * self.log_sum

    def slope(self, lam: float) -> float:
        # derivative by a complex step: no difference of near values
        return float(np.imag(self.likelihood(complex(lam, 1e-30))) / 1e-30)

    def constant(self) -> bool:
        """No values, or all alike: there is no likelihood."""
        if not self.n:
            return True
        return bool(self._log_spread() <= 1e-30 * max(1.0, self.centre ** 2))

    def _log_spread(self) -> float:
        """The population variance of ln x."""
        return float((self.sums[0] * self.middle ** 2 + 2 * self.middle * self.sums[1] + self.sums[2]).sum() / self.n)

    def _root(self, f, slope, lo: float, hi: float) -> float:
        """Root of f between lo and hi (of opposite signs): Newton steps, halving where one leaves the bracket."""
        rising, at = f(hi) > 0, (lo + hi) / 2
        for _ in range(80):
            value = f(at)
            if value == 0:
                return at
            lo, hi = (lo, at) if (value > 0) == rising else (at, hi)
            d = slope(at)
            new = at - value / d if d else lo
            new = new if lo < new < hi else (lo + hi) / 2
            if abs(new - at) <= 1e-13 * max(1.0, abs(at)):
                return new
            at = new
        return at

    def best(self) -> float:
        """The λ of largest likelihood."""
        side = 1.0 if self.slope(0.0) > 0 else -1.0
        far = 0.25
        while side * self.slope(side * far) > 0 and far < _FAR:
            far *= 2
        lo, hi = sorted((0.0, side * far))
        return self._root(self.slope, lambda lam: (self.slope(lam + 1e-4) - self.slope(lam - 1e-4)) / 2e-4, lo, hi)

    def end(self, best: float, side: float, drop: float) -> float | None:
        """Where the likelihood has fallen by ``drop`` on one side of the best λ; None beyond |λ| = 32."""
        floor = float(self.likelihood(best)) - drop

        def below(lam: float) -> float:
            return float(self.likelihood(lam)) - floor

        far = 1e-3
        while below(best + side * far) > 0:
            far *= 2
            if abs(best + side * far) > _FAR:
                return None
        lo, hi = sorted((best, best + side * far))
        return self._root(below, self.slope, lo, hi)


def boxcox_profile(df: DataFrame, col: str, lambdas: Sequence[float] | None = None) -> DataFrame:
    """(lambda, llf): the profile log-likelihood of each λ of a grid, from one pass over the values.

    llf(λ) = −n/2 · ln(σ²_λ) + (λ − 1) · Σ ln x, σ²_λ the population variance of the
    transformed values (normal MLE). NULL where there are no values, or only equal ones.
    """
    model = BoxCox(df, col)
    void = model.constant()
    rows = [(float(v), None if void else float(model.likelihood(float(v)))) for v in lambdas or boxcox_grid()]
    return df.sparkSession.createDataFrame(rows, "lambda double, llf double")


def boxcox_fit(df: DataFrame, col: str, drop: float = _DROP) -> DataFrame:
    """(n, lambda, llf, ci_low, ci_high): the most likely λ and its likelihood interval, in one row.

    λ is found by Newton steps on the derivative of the likelihood, the interval's ends where
    the likelihood has fallen by ``drop`` (95 % unless given). All but n are NULL where there
    are no values, or only equal ones; an end beyond |λ| = 32 is NULL.
    """
    model = BoxCox(df, col)
    if model.constant():
        row = (int(model.n), None, None, None, None)
    else:
        best = model.best()
        row = (int(model.n), best, float(model.likelihood(best)), model.end(best, -1.0, drop), model.end(best, 1.0, drop))
    return df.sparkSession.createDataFrame([row], "n long, lambda double, llf double, ci_low double, ci_high double")
