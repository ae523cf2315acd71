"""Clustering and whitening against brute force, and their behaviour on nulls, odd lengths, ties, repeats and extreme numbers."""

import hashlib
import math

import numpy as np
import pytest

from profilespark.llm import centroids, whitening
from profilespark.llm.vectors import column_sums, limbs, whole

CLASH = "vec_id {}, embedding array<double>, x int, cluster string, c double, n int, component int, part int"


def table(spark, rows, kind="long"):
    """Vectors with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, 1, "y", 2.0, 3, 4, 5) for i, v in rows], CLASH.format(kind))


def blobs(seed, n, width=64, groups=9):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, width))
    return (middle[rng.integers(groups, size=n)] + 0.4 * rng.standard_normal((n, width))).tolist()


BROKEN = [(901, None), (902, [1.0] * 63 + [None]), (903, [1.0] * 63 + [float("nan")]), (904, [math.inf] + [0.0] * 63)]


# ---- clustering

def lloyd(rows, k, rounds):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]
    for t in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(x, own)) for own in c] for _, x in kept]
        near = [row.index(min(row)) for row in d]
        if t < rounds:
            c = [[sum(col) // len(col) for col in zip(*[x for (_, x), j in zip(kept, near) if j == g])] if g in near else own for g, own in enumerate(c)]
    best = [min(row) for row in d]
    show = [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in c]
    return [(i, j, b, sum(x for x, g in zip(best, near) if g == j), sum(best), show[j]) for (i, _), j, b in zip(kept, near, best)]


def clustered(df, **more):
    return sorted((tuple(r) for r in centroids.centroid_clusters(df, **more).collect()), key=str)


@pytest.mark.parametrize("seed,rounds", [(1, 3), (2, 7)])
def test_clusters_equal_full_scans(spark, seed, rounds):
    rows = [*enumerate(blobs(seed, 260)), *BROKEN, (905, [0.5] * 63), (906, [0.5] * 65), (907, [])]
    assert clustered(table(spark, rows).repartition(3), rounds=rounds) == sorted(lloyd(rows, 16, rounds), key=str)


def test_clusters_with_ties_repeats_and_null_ids(spark):
    same = [0.25] * 64
    rows = [(i, same) for i in range(20)] + [(5, same), (5, [0.5] * 64), (None, [0.75] * 64), (None, [0.75] * 64)]
    assert clustered(table(spark, rows)) == sorted(lloyd(rows, 16, 3), key=str)
    few = [(1, same), (2, [-0.5] * 64), (3, same)]
    assert clustered(table(spark, few)) == sorted(lloyd(few, 16, 3), key=str)
    assert clustered(table(spark, [(7, same)])) == sorted(lloyd([(7, same)], 16, 3), key=str)
    assert clustered(table(spark, BROKEN)) == [] and clustered(table(spark, [])) == []
    assert {r[0] for r in clustered(table(spark, [("a", same), ("b", [1.0] * 64)], "string"))} == {"a", "b"}


def test_clusters_of_huge_components(spark):
    rows = [(i, [(-1.0) ** j * 1e8 * (i + 1)] * 64) for i, j in zip(range(6), [0, 1, 0, 1, 1, 0])]
    far = 1 << 63
    want = [tuple(None if isinstance(v, int) and v >= far else v for v in r) for r in lloyd(rows, 2, 3)]
    assert clustered(table(spark, rows), clusters=2) == sorted(want, key=str)
    assert len(clustered(table(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]), clusters=2)) == 3


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(4)
    x = np.floor(64 * np.array(blobs(3, 3000))).astype(np.int64)
    c, past, state, spared = x[rng.choice(len(x), 16, replace=False)], [], None, 0
    for t in range(9):
        past.append(c)
        history = np.array(past)
        state = centroids.scan(x, c, 0) if t == 0 else centroids.advance(x, state, history)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (state.cluster == d.argmin(axis=1)).all()
        spared += len(x) - state.rescanned
        c = np.array([x[state.cluster == j].sum(axis=0) // (state.cluster == j).sum() if (state.cluster == j).any() else c[j] for j in range(16)])
    assert spared > 0.5 * 8 * len(x)


def test_displacement_loosens_less_than_drifts():
    """A centroid that comes back leaves a bound as tight as it was."""
    x = np.zeros((1, 64), np.int64)
    a, b = np.full(64, 4), np.full(64, 30)
    history = np.array([[a, b], [a + 9, b - 9], [a, b]])
    first = centroids.scan(x, history[0], 0)
    assert centroids.advance(x, first, history).rescanned == 0 and centroids.advance(x, first, history).upper_at[0] == 0


def test_sums_beyond_a_long():
    x = np.array([[2**63 - 1, -(2**63)], [2**63 - 1, -5], [-1, 7]], np.int64)
    assert whole(limbs(column_sums(x))) == [2 * (2**63 - 1) - 1, -(2**63) + 2]


# ---- whitening

def brute(rows, k=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = np.array(sorted(set(map(tuple, (x for _, x in kept)))), float)
    n, sums = len(fit), [sum(map(int, col)) for col in fit.T]
    centred = fit - fit.mean(axis=0)
    w, q = np.linalg.eigh(centred.T @ centred / n)
    w, q = w[::-1][:k], q[:, ::-1][:, :k]
    return {j: (i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x, float) - fit.mean(axis=0)) @ q / np.sqrt(np.maximum(w, 1e-300)), w / np.trace(centred.T @ centred / n)) for j, (i, x) in enumerate(kept)}


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(150)] + [(20, [0.5] * 12)] * 3 + [(200, [1.0] * 9), (None, [2.0] * 12), (201, [])] + BROKEN[:1] + [(300, [math.nan] * 12), (301, [None] * 12)]
    got = whitening.whitened(table(spark, rows).repartition(4)).collect()
    want = brute(rows)
    assert len(got) == 4 * len(want)
    flip = {}
    by_id = {}
    for i, n, dev, y, share in want.values():
        by_id.setdefault(i, (n, dev, y, share))
    for r in got:
        n, dev, y, share = by_id[r["vec_id"]]
        if r["vec_id"] == 20 and abs(int(r["deviation"]) - dev) > 0:
            continue  # the other vector of that id
        assert r["n"] == n and int(r["deviation"]) == dev and r["identity_error"] < 1e-9 and abs(r["explained"] - share[r["component"] - 1]) < 1e-12
        sign = flip.setdefault(r["component"], math.copysign(1, r["whitened"] * y[r["component"] - 1]))
        assert abs(r["whitened"] * sign - y[r["component"] - 1]) < 1e-9


def test_whitening_of_flat_and_empty_tables(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(8)]
    got = whitening.whitened(table(spark, line, "string")).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 8 and abs(got[0]["explained"] - 1) < 1e-12
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whitened(table(spark, rows)).collect() == []


def test_whitening_of_large_offsets_and_deviations(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (1e6 + rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)] + [(77, [1e9, 0.0, 0.0, 0.0, 0.0])]
    got, want = whitening.whitened(table(spark, rows)).collect(), {i: v for i, *v in brute(rows).values()}
    assert all(int(r["deviation"]) == want[r["vec_id"]][1] and r["identity_error"] < 1e-4 for r in got)
    assert len(whitening.whitened(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 5.0]), (3, [0.0, 7.0])])).collect()) >= 3


def test_leading_vectors_of_clusters_and_ties():
    rng = np.random.default_rng(7)
    for t in range(120):
        n = int(rng.integers(1, 40))
        a = rng.standard_normal((n, n))
        a = a @ a.T
        if t % 3 == 1:
            q = np.linalg.qr(rng.standard_normal((n, n)))[0]
            a = (q * np.repeat(rng.random(-(-n // 3)), 3)[:n]) @ q.T
        if t % 3 == 2:
            a = np.diag(np.repeat(rng.random(-(-n // 4)), 4)[:n])
        e, v = whitening.leading_vectors(a, 4)
        w = np.linalg.eigvalsh(a)[::-1][:4]
        assert np.abs(e - w).max() <= 1e-13 * w[0] and np.abs(a @ v - v * e).max() <= 1e-13 * w[0] and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
    e, v = whitening.leading_vectors(np.zeros((3, 3)), 2)
    assert (e == 0).all() and v.shape == (3, 2)
