"""Student-t thresholds by numerical quadrature: the check on ``functions.student``, sharing no code with it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _tail(t: np.ndarray, nu: np.ndarray, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """P(T > t): with T = sqrt(nu) tan(a) the density becomes cos(a)**(nu-1), integrated by Gauss-Legendre.

    The range is cut where the integrand has fallen by exp(-80), and the constant comes from the same rule over the
    positive half line.
    """
    top = np.minimum(np.pi / 2, np.arccos(np.exp(-np.minimum(80.0 / np.maximum(nu - 1.0, 1e-9), 700.0))))

    def integral(lo, hi):
        half, mid = (hi - lo) / 2, (hi + lo) / 2
        a = mid[:, None] + half[:, None] * nodes[None, :]
        logs = (nu[:, None] - 1.0) * np.log(np.maximum(np.cos(a), 1e-300))
        return half * (np.exp(logs) * weights[None, :]).sum(axis=1)

    start = np.arctan(t / np.sqrt(nu))
    end = np.maximum(top, np.minimum(start + (np.pi / 2 - start) * 0.999999999, np.pi / 2))
    end = np.where(start >= top, np.pi / 2, top)
    return 0.5 * integral(start, end) / integral(np.zeros_like(start), top)


@lru_cache(maxsize=None)
def lambda_table(lo: int, hi: int, alpha: float) -> tuple[float, ...]:
    n = np.arange(lo, hi, dtype=float)
    nu, q = n - 2.0, alpha / n
    nodes, weights = np.polynomial.legendre.leggauss(64)
    a, b = np.zeros_like(n), np.full_like(n, 24.0)
    for _ in range(50):
        mid = (a + b) / 2
        more = _tail(mid, nu, nodes, weights) > q
        a, b = np.where(more, mid, a), np.where(more, b, mid)
    t = (a + b) / 2
    return tuple((n - 1) * t / np.sqrt((n - 2 + t * t) * n))
