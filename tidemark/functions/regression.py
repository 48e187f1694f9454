"""Weighted linear regression over a whole table, with p-values and robust errors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_p(t: float, freedom: float) -> float:
    """Probability of a |t| as large, by Student's distribution."""
    return float("nan") if math.isnan(t) else incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


@dataclass(frozen=True)
class RegressionModel:
    beta: np.ndarray  # intercept first, if any
    intercept: bool
    n: int
    gram: np.ndarray
    rss: float
    tss: float
    log_weights: float
    meat: np.ndarray  # sum of (w e)^2 x x'

    @property
    def freedom(self) -> int:
        return self.n - len(self.beta)

    @property
    def covariance(self) -> np.ndarray:
        return self.rss / self.freedom * np.linalg.inv(self.gram)

    @property
    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def t_stats(self) -> np.ndarray:
        return self.beta / self.standard_errors

    @property
    def p_values(self) -> np.ndarray:
        return np.array([two_sided_p(t, self.freedom) for t in self.t_stats])

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss

    @property
    def adjusted_r_squared(self) -> float:
        return 1 - (1 - self.r_squared) * (self.n - self.intercept) / self.freedom

    @property
    def eigenvalues(self) -> np.ndarray:
        return np.linalg.eigvalsh(self.gram)

    @property
    def log_likelihood(self) -> float:
        return -self.n / 2 * math.log(self.rss) - self.n / 2 * (1 + math.log(2 * math.pi / self.n)) + self.log_weights / 2

    @property
    def akaike(self) -> float:
        return -2 * self.log_likelihood + 2 * len(self.beta)

    @property
    def bayes(self) -> float:
        return -2 * self.log_likelihood + len(self.beta) * math.log(self.n)

    def robust_errors(self, kind: str = "HC0") -> np.ndarray:
        """White's errors; HC1 with the correction for lost degrees of freedom."""
        bread = np.linalg.inv(self.gram)
        scale = self.n / self.freedom if kind == "HC1" else 1.0
        return np.sqrt(np.diag(scale * bread @ self.meat @ bread))

    def predict(self, *xs: Column) -> Column:
        out = F.lit(float(self.beta[0])) if self.intercept else F.lit(0.0)
        for b, x in zip(self.beta[self.intercept :], xs, strict=True):
            out = out + float(b) * x
        return out


def regression(df: DataFrame, label: str, features: list[str], weight: str | None = None, intercept: bool = True) -> RegressionModel:
    """Two aggregations: sums of products, then residuals. Rows with a null in any column are left out."""
    used = df.dropna(subset=[label, *features, *([weight] if weight else [])])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    xs = [*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") for c in features]]
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = used.agg(*[F.sum(w * xs[i] * xs[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(w * x * y).alias(f"b{i}") for i, x in enumerate(xs)], F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(F.ln(w)).alias("lw")).first()
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
    beta = np.linalg.solve(gram, np.array([sums[f"b{i}"] for i in range(k)]))
    fitted = F.lit(0.0)
    for b, x in zip(beta, xs, strict=True):
        fitted = fitted + float(b) * x
    e = y - fitted
    centre = sums["wy"] / sums["w"] if intercept else 0.0
    second = used.agg(F.sum(w * e * e).alias("rss"), F.sum(w * (y - centre) * (y - centre)).alias("tss"), *[F.sum(w * w * e * e * xs[i] * xs[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = second[f"m{i}_{j}"]
    return RegressionModel(beta, intercept, sums["n"], gram, second["rss"], second["tss"], sums["lw"], meat)
