import numpy as np
import pytest

from profilespark.operators import models as M
from profilespark.operators import spectrum as P


def long(spark, mats):
    rows = [(g, f"p{i:03d}", f"p{j:03d}", float(m[i, j])) for g, m in mats.items() for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "grp string, a string, b string, value double")


def matrices():
    """50 symmetric matrices: definite, indefinite, of low rank, with equal eigenvalues, zero."""
    rng = np.random.default_rng(1)
    out = {}
    for t in range(50):
        n = int(rng.integers(3, 75))
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        w = [rng.standard_normal(n), rng.random(n), np.where(np.arange(n) < max(1, n // 5), rng.standard_normal(n), 0), np.repeat(rng.standard_normal(-(-n // 12)), 12)[:n], np.where(np.arange(n) < 1, 5.0, 1e-9 * rng.random(n))][t % 5]
        out[f"g{t:02d}"] = (q * w) @ q.T if t != 49 else np.zeros((n, n))
    return {g: (m + m.T) / 2 for g, m in out.items()}


@pytest.mark.parametrize("side,width", [(256, 32), (20, 6)])
def test_spectra_equal_numpy(spark, monkeypatch, side, width):
    monkeypatch.setattr(P, "SIDE", side)
    monkeypatch.setattr(P, "WIDTH", width)
    mats = matrices() if side == 256 else dict(list(matrices().items())[-10:])
    found, vectors = P.spectra(long(spark, mats), {g: len(m) for g, m in mats.items()}, 2)
    lead = {}
    for r in vectors.collect():
        lead.setdefault(r["grp"], {})[r["name"]] = r["v"]
    for g, m in mats.items():
        w, s = np.linalg.eigvalsh(m), found[g]
        tol = 1e-12 * max(1, np.abs(w).max())
        assert s.whole
        got = np.sort(np.concatenate((s.values, np.zeros(len(m) - len(s.values)))))
        assert np.abs(got - w).max() < tol, g
        if len(s.values):
            v = np.array([lead[g][f"p{i:03d}"] for i in range(len(m))])
            assert np.abs(m @ v - v * s.values[:2]).max() < 20 * tol and np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12


def test_a_stopped_run_says_so(spark):
    m = matrices()["g05"]
    found, _ = P.spectra(long(spark, {"x": np.kron(np.diag([1.0, 2.0, 3.0]), m)}), {"x": 3 * len(m)}, 2, max_rounds=1)
    assert not found["x"].whole and found["x"].residual > 0


def gram(d):
    c = np.eye(len(d)) - 1 / len(d)
    return -0.5 * c @ (d * d) @ c


def test_scaling_of_many_matrices_equals_numpy(spark):
    """50 distance matrices, half of them not Euclidean, so that eigenvalues are negative as well."""
    rng = np.random.default_rng(2)
    mats = {}
    for t in range(50):
        n = int(rng.integers(3, 45))
        x = rng.standard_normal((n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if t % 2 else np.abs(rng.standard_normal((n, n)))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        mats[f"g{t:02d}"] = d
    fit = M.pcoa(long(spark, mats), group="grp")
    coords = fit.scores.toPandas()
    status = {r["analysis_id"]: r for r in fit.status.collect()}
    assert set(status) == set(mats)
    for g, d in mats.items():
        w, q = np.linalg.eigh(gram(d))
        w, q = w[::-1], q[:, ::-1]
        positive = w[w > 1e-12]
        s, own = status[g], coords[coords.analysis_id == g].sort_values("profile")
        assert s["status"] == "PASS" and s["converged"] and s["rank"] == len(positive) and abs(s["explained_variance_sum"] - positive[:2].sum() / positive.sum()) < 1e-10
        assert abs(own["Axis1_variance_fraction"].iloc[0] - positive[0] / positive.sum()) < 1e-10
        for i in range(min(2, len(positive))):
            if i + 1 < len(w) and w[i] - w[i + 1] > 1e-6 and (i == 0 or w[i - 1] - w[i] > 1e-6):
                assert np.abs(np.abs(own[f"Axis{i + 1}"].to_numpy()) - np.abs(q[:, i] * np.sqrt(w[i]))).max() < 1e-7


def test_scaling_that_is_stopped_has_a_limitation(spark):
    rng = np.random.default_rng(3)
    d = np.abs(rng.standard_normal((80, 80)))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    s = M.pcoa(long(spark, {"x": d}), max_rounds=1).status.first()
    assert s["status"] == "PASS_WITH_LIMITATION" and s["rank"] is None and not s["converged"] and "residual" in s["reason"]


def test_metric_scaling_equals_plain_majorisation(spark):
    """Distances of points in the plane are met; others reach the stress that plain rounds reach from as many starts."""
    rng = np.random.default_rng(5)
    flat = rng.standard_normal((30, 2))
    rough = np.abs(rng.standard_normal((17, 17)))
    rough = (rough + rough.T) / 2
    np.fill_diagonal(rough, 0)
    mats = {"flat": np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(2)), "rough": rough}
    fit = M.metric_mds(long(spark, mats), 1, n_init=6, max_iter=60, eps=1e-5, group="grp")
    got = {r["analysis_id"]: r for r in fit.status.collect()}
    assert got["flat"]["stress"] < 1e-2 * (mats["flat"] ** 2).sum() and got["flat"]["sample_count"] == 30
    best = np.inf
    for s in range(6):
        x = np.random.default_rng([9, s]).random((17, 2))
        for _ in range(60):
            gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
            pull = np.where(gap > 1e-12, rough / np.where(gap > 1e-12, gap, 1), 0)
            x = (x * pull.sum(1, keepdims=True) - pull @ x) / 17
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        best = min(best, ((gap - rough) ** 2).sum() / 2)
    assert got["rough"]["stress"] < 1.15 * best
    check = M.metric_mds_check(long(spark, mats), fit, group="grp").collect()
    assert all(r["stress_agrees"] for r in check)
