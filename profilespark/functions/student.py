"""Student-t quantiles for the outlier threshold, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a, b, x):
    """Regularised incomplete beta I_x(a, b) by its continued fraction, for x below the turning point."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        m2 = 2 * m
        for num in (m * (b - m) * x / ((qam + m2) * (a + m2)), -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 5e-16):
            break
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    return front * h / a


def t_sf(t, nu):
    """Upper tail of Student's t for t >= 0."""
    t, nu = np.asarray(t, float), np.asarray(nu, float)
    x = np.clip(nu / (nu + t * t), 1e-300, 1.0 - 1e-16)
    a, b = nu / 2.0, np.full_like(nu, 0.5)
    turned = x > (a + 1.0) / (a + b + 2.0)
    out = np.empty_like(x)
    if (~turned).any():
        k = ~turned
        out[k] = _beta_fraction(a[k], b[k], x[k])
    if turned.any():
        k = turned
        out[k] = 1.0 - _beta_fraction(b[k], a[k], 1.0 - x[k])
    return 0.5 * out


def t_upper_quantile(q, nu):
    """t with upper tail mass q (0 < q < 1/2): Newton's method on log tail against log t.

    That curve is concave and falling, so from the first overshoot on the iterates close in from one side.
    """
    q, nu = np.asarray(q, float), np.asarray(nu, float)
    log_norm = _lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(nu * math.pi)
    u = 0.5 * np.log(-2.0 * np.log(2.0 * q) + 0.1)
    for _ in range(60):
        t = np.exp(u)
        tail = t_sf(t, nu)
        slope = -np.exp(log_norm - (nu + 1) / 2 * np.log1p(t * t / nu) + u) / tail
        step = (np.log(tail) - np.log(q)) / slope
        u = u - np.clip(step, -3.0, 3.0)
        if np.all(np.abs(step) < 1e-11):
            break
    return np.exp(u)


def critical_lambda(n, alpha):
    """One-sided generalized-ESD threshold for n values left in the set."""
    n, alpha = np.asarray(n, float), np.asarray(alpha, float)
    tail = 1.0 - (1.0 - alpha / n)
    t = t_upper_quantile(tail, n - 2.0)
    return (n - 1.0) * t / np.sqrt((n - 2.0 + t * t) * n)


@F.pandas_udf(T.DoubleType())
def gesd_critical(n: pd.Series, alpha: pd.Series) -> pd.Series:
    """Threshold column; each Arrow batch solves its distinct (n, alpha) once, so no shuffle is needed."""
    frame = pd.DataFrame({"n": n, "alpha": alpha})
    distinct = frame.drop_duplicates()
    ok = (distinct["n"] >= 3) & distinct["alpha"].notna()
    solved = distinct[ok].copy()
    solved["lam"] = critical_lambda(solved["n"].to_numpy(), solved["alpha"].to_numpy()) if len(solved) else []
    return frame.merge(solved, on=["n", "alpha"], how="left")["lam"].astype(float)
