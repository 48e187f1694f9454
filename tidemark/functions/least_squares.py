"""Least squares from sums of products, and the statistics that go with it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SCHEMA = (
    "samples long, beta array<double>, intercept double, hasIntercept boolean, stdErr_intercept double, stdErr_beta array<double>, rSquared double, r double, "
    "tStat_intercept double, tStat_beta array<double>, logLikelihood double, akaikeIC double, bayesIC double, cond double, const_columns array<string>"
)
KINDS = dict(x.split() for x in SCHEMA.split(", "))
FIELDS = list(KINDS)


def unpacked(sums: np.ndarray, k: int, n_x: int) -> tuple:
    half = k * (k + 1) // 2
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = sums[:half]
    gram = gram + np.triu(gram, 1).T
    return gram, sums[half : half + k], sums[half + k : half + k + n_x], sums[half + k + n_x :]


def solve(sums: np.ndarray, xs: list[str], intercept: bool, ignore_const: bool, bound: float) -> dict:
    """With an intercept, sums are of differences from centres (of each x, and y); results are as if they weren't."""
    gram, xy, spread, (yy, w, log_w, wy, n, *centres) = unpacked(sums, len(xs) + intercept, len(xs))
    nan = float("nan")
    const = [i for i in range(len(xs)) if n * spread[i] < bound]
    out = {
        "samples": int(n), "beta": [nan] * len(xs), "intercept": nan, "hasIntercept": intercept, "stdErr_intercept": nan, "stdErr_beta": [nan] * len(xs), "rSquared": nan, "r": nan,
        "tStat_intercept": nan, "tStat_beta": [nan] * len(xs), "logLikelihood": nan, "akaikeIC": nan, "bayesIC": nan, "cond": nan, "const_columns": [xs[i] for i in const],
    }
    if not intercept:
        out["intercept"] = 0.0
    drop = set(const) if ignore_const else set()
    used = [*([0] if intercept else []), *[i + intercept for i in range(len(xs)) if i not in drop]]
    k = len(used)
    if n <= k or not k:
        return out
    a, b = gram[np.ix_(used, used)], xy[used]
    values = np.linalg.eigvalsh(a)
    if not np.isfinite(values).all() or values[0] <= values[-1] * 1e-15:
        return out
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rss = max(0.0, yy - 2 * beta @ b + beta @ a @ beta)  # of centred sums
    used_x = [x - intercept for x in used if x >= intercept]
    if intercept:  # back to what isn't centred
        shift = np.array([centres[i] for i in used_x])
        back = np.eye(k)
        back[0, 1:] = -shift
        forth = np.eye(k)
        forth[1:, 0] = shift
        beta, inverse = back @ beta, back @ inverse @ back.T
        beta[0] += centres[-1]
        values = np.linalg.eigvalsh(forth @ a @ forth.T)
    with np.errstate(all="ignore"):
        se = np.sqrt(np.maximum(rss / (n - k) * np.diag(inverse), 0))
        t = beta / se
    tss = yy - wy * wy / w if intercept and w else yy
    r2 = 1 - rss / tss if yy and w and tss > 0 else nan
    log_l = -n / 2 * math.log(rss) - n / 2 * (1 + math.log(2 * math.pi / n)) + log_w / 2 if rss > 0 else float("inf")
    out |= {"rSquared": r2, "r": math.sqrt(r2) if r2 >= 0 else nan, "logLikelihood": log_l, "akaikeIC": -2 * log_l + 2 * k, "bayesIC": -2 * log_l + k * math.log(n), "cond": values[-1] / values[0]}
    if intercept:
        out |= {"intercept": beta[0], "stdErr_intercept": se[0], "tStat_intercept": t[0]}
    place = {x: j for j, x in enumerate(used)}
    for name, found, fill in (("beta", beta, 0.0), ("stdErr_beta", se, 0.0), ("tStat_beta", t, nan)):
        out[name] = [float(found[place[i + intercept]]) if i not in drop else fill for i in range(len(xs))]
    return out


def solver(xs: list[str], intercept: bool, ignore_const: bool, bound: float):
    @F.pandas_udf(SCHEMA)
    def solved(sums: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([solve(np.asarray(s, float), xs, intercept, ignore_const, bound) for s in sums], columns=FIELDS)

    return solved
