import numpy as np
from pyspark.sql import functions as F

from profilespark.operators import models as M


def frame(spark, x):
    rows = [(f"p{i:02d}", f"f{j:02d}", j, f"t{j % 3}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "profile string, feature_id string, feature_order long, target string, value double")


def em(x, rounds, k=2):
    seen = np.isfinite(x)
    full = np.where(seen, x, np.nanmean(x, 0))
    for _ in range(rounds):
        mu = full.mean(0)
        u, s, vt = np.linalg.svd(full - mu, full_matrices=False)
        full = np.where(seen, x, (u[:, :k] * s[:k]) @ vt[:k] + mu)
    mu = full.mean(0)
    u, s, vt = np.linalg.svd(full - mu, full_matrices=False)
    return np.abs(u[:, :k] * s[:k]), s[:k] ** 2 / (s ** 2).sum()


def scores(model):
    d = model.scores.toPandas().sort_values("profile")
    return np.abs(d[["PC1", "PC2"]].to_numpy(float))


def test_em_svd_both_orientations(spark):
    rng = np.random.default_rng(1)
    for shape in ((14, 6), (5, 12)):
        x = rng.standard_normal(shape)
        x[rng.random(shape) < 0.15] = np.nan
        m = M.em_svd_pca(frame(spark, x), "value", max_iter=12, tol=0.0)
        want, share = em(x, 12)
        assert np.abs(scores(m) - want).max() < 1e-9
        st = m.status.collect()[0]
        assert st.status == "PASS_WITH_LIMITATION" and st.iterations == 12 and abs(st.explained_variance_sum - share.sum()) < 1e-9


def test_complete_case_and_too_small(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6, 5))
    x[0, 4] = np.nan
    m = M.complete_case_pca(frame(spark, x), "value")
    want, _ = em(x[:, :4], 0)
    assert np.abs(scores(m) - want).max() < 1e-9 and m.status.collect()[0].status == "PASS"
    tiny = M.em_svd_pca(frame(spark, x[:2]), "value").status.collect()[0]
    assert tiny.status == "NOT_ESTIMABLE"


def test_axes_do_not_move_with_the_query(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8, 5))
    x[7, 1] = np.nan
    ref = spark.createDataFrame([(f"p{i:02d}",) for i in range(7)], "profile string")
    ask = spark.createDataFrame([("p07",)], "profile string")
    y = x.copy()
    y[7] *= -100
    got = [{r.profile: (r.PC1, r.PC2) for r in M.fixed_reference_pca(frame(spark, z), "value", ref, ask, max_iter=3).scores.collect()} for z in (x, y)]
    assert all(np.allclose(got[0][p], got[1][p]) for p in got[0] if p != "p07") and not np.allclose(got[0]["p07"], got[1]["p07"])


def full(spark, d):
    n = len(d)
    return spark.createDataFrame([("g", f"p{i:02d}", f"p{j:02d}", float(d[i, j])) for i in range(n) for j in range(n)], "g string, a string, b string, value double")


def test_scaling_and_linkage(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((9, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    c = M.pcoa(full(spark, d)).scores.toPandas().sort_values("profile")[["Axis1", "Axis2"]].to_numpy()
    assert np.abs(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) - d).max() < 1e-9
    live, want = {i: [i] for i in range(9)}, []
    while len(live) > 1:
        h, i, j = min((np.mean([d[p, q] for p in live[i] for q in live[j]]), i, j) for i in live for j in live if i < j)
        live[i] += live.pop(j)
        want.append((round(h, 9), f"p{i:02d}", f"p{j:02d}", len(live[i])))
    got = sorted((round(r.distance, 9), r.left_cluster, r.right_cluster, r.member_count) for r in M.average_linkage_by_group(full(spark, d).where("a < b"), "g").collect())
    assert got == sorted(want)


def test_complete_distance_subset(spark):
    pairs = spark.createDataFrame([("a", "b", None), ("a", "c", None), ("a", "d", 1.0), ("b", "c", 1.0), ("b", "d", None), ("c", "d", 1.0), ("a", "e", 1.0), ("b", "e", 1.0), ("c", "e", 1.0), ("d", "e", 2.0)], "a string, b string, rms double")
    cover = spark.createDataFrame(list(zip("abcde", [5, 4, 3, 2, 1])), "profile string, coverage long")
    kept, out = M.complete_distance_subset(pairs, cover, "rms")
    assert sorted(r.profile for r in kept.collect()) == ["a", "d", "e"] and [r.profile for r in out.orderBy("exclusion_order").collect()] == ["b", "c"]


def table_of(spark, x, name="p"):
    return spark.createDataFrame([(f"{name}{i}", f"f{j}", j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v == v], "profile string, feature_id string, feature_order long, value double")


def test_rank_of_rank_one_tables(spark):
    rng = np.random.default_rng(3)
    parts = None
    for g in range(40):
        m, f = rng.integers(3, 9), rng.integers(2, 9)
        t = table_of(spark, np.outer(rng.standard_normal(m), rng.standard_normal(f)) + rng.standard_normal(f)).withColumn("grp_label", F.lit(f"g{g:02d}"))
        parts = t if parts is None else parts.unionByName(t)
    fit = M.complete_case_pca(parts, "value", group="grp_label")
    status = fit.status.collect()
    assert len(status) == 40 and all(r["rank"] == 1 and r["component_count"] == 1 for r in status)
    assert fit.scores.where("PC2 is not null").count() == 0


def test_large_offsets_lose_no_digits(spark):
    rng = np.random.default_rng(4)
    x = 1e7 + rng.standard_normal((30, 5)) * np.array([3, 2, 1, 1, 1])
    status = M.complete_case_pca(table_of(spark, x), "value").status.first()
    w = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert abs(status["explained_variance_sum"] - w[:2].sum() / w.sum()) < 1e-9


def test_fits_by_passes_and_inside_a_task_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12, 2)) @ rng.standard_normal((2, 6)) + 0.1 * rng.standard_normal((12, 6))
    x[rng.random(x.shape) < 0.2] = np.nan
    t = table_of(spark, x)
    near = M.em_svd_pca(t, "value", max_iter=12, tol=0.0)
    monkeypatch.setattr(M, "CELLS_PER_TASK", 1)
    far = M.em_svd_pca(t, "value", max_iter=12, tol=0.0)
    a, b = near.status.first(), far.status.first()
    assert a["iterations"] == b["iterations"] == 12 and abs(a["observed_reconstruction_rmse"] - b["observed_reconstruction_rmse"]) < 1e-12
    rows = {r["profile"]: r for r in far.scores.collect()}
    assert all(abs(r["PC1"] - rows[r["profile"]]["PC1"]) < 1e-9 for r in near.scores.collect())


def test_scaling_refuses_uneven_distances(spark):
    full = [(a, b, float(abs(ord(a) - ord(b)))) for a in "abcd" for b in "abcd"]
    turned = [(a, b, v + (0.5 if (a, b) == ("a", "b") else 0.0)) for a, b, v in full]
    holes = [r for r in full if r[:2] != ("c", "a")]
    schema = "a string, b string, value double"
    assert M.pcoa(spark.createDataFrame(full, schema)).status.first()["status"] == "PASS"
    for rows in (turned, holes):
        assert M.pcoa(spark.createDataFrame(rows, schema)).status.first()["status"] == "NOT_ESTIMABLE"
        assert M.metric_mds(spark.createDataFrame(rows, schema), 1).status.first()["status"].startswith("NOT_ESTIMABLE")


def test_trees_by_rounds_and_inside_a_task_agree(spark, monkeypatch):
    """Few jobs where a group fits a task; the same tree by rounds, by rounds that end inside a task, and with equal distances or holes."""
    rng = np.random.default_rng(6)
    rows = []
    for g in "uvwx":
        p = rng.integers(0, 3, (14, 2)).astype(float) if g == "v" else rng.standard_normal((14, 3))
        rows += [(g, f"p{i:02d}", f"p{j:02d}", float(np.sqrt(((p[i] - p[j]) ** 2).sum()))) for i in range(14) for j in range(i + 1, 14) if g != "w" or (i + j) % 5]
    d = spark.createDataFrame(rows, "g string, a string, b string, value double")

    def tree():
        return sorted((r.g, r.left_cluster, r.right_cluster, round(r.distance, 9), r.member_count) for r in M.average_linkage_by_group(d, "g").collect())

    cuts = []
    monkeypatch.setattr(M, "cut", lambda df, cut=M.cut: cuts.append(1) or cut(df))
    want, one = tree(), len(cuts)
    assert one == 2 and len(want) == 4 * 13
    for cells in (0, 50):
        monkeypatch.setattr(M, "CELLS_PER_TASK", cells or 1)
        assert tree() == want
    assert M.average_linkage_by_group(d.limit(0), "g").count() == 0


def test_scaling_by_rounds_and_inside_a_task_agree(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for g in "uvw":
        p = rng.standard_normal((40, 3))
        rows += [(g, f"p{i:02d}", f"p{j:02d}", float(np.sqrt(((p[i] - p[j]) ** 2).sum()))) for i in range(40) for j in range(40)]
    d = spark.createDataFrame(rows, "g string, a string, b string, value double").cache()

    def fits():
        flat, mds = M.pcoa(d, group="g"), M.metric_mds(d, 3, n_init=2, max_iter=5, group="g")
        at = {(r["analysis_id"], r["profile"]): (r["Axis1"], r["Axis2"]) for r in flat.scores.collect()} | {("m", r["analysis_id"], r["profile"]): (r["MDS1"], r["MDS2"]) for r in mds.scores.collect()}
        return at, sorted((r["analysis_id"], r["status"], r["rank"], round(r["explained_variance_sum"], 9)) for r in flat.status.collect()), sorted((r["analysis_id"], r["status"], r["iterations"], round(r["stress"], 6)) for r in mds.status.collect())

    def lanczos(*_):
        raise AssertionError("small groups need no rounds of jobs")

    with monkeypatch.context() as m:
        m.setattr(M, "spectra", lanczos)
        near = fits()
    monkeypatch.setattr(M, "CELLS_PER_TASK", 100)
    far = fits()
    assert near[1:] == far[1:] and len(near[0]) == 240 == len(far[0])
    assert all(abs(x - y) < 1e-8 for key, pair in near[0].items() for x, y in zip(pair, far[0][key]))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inputs_of_a_model_are_worked_out_once(spark, sf, monkeypatch):
    """What several passes read starts from a written table, not from the joins behind it."""
    from profilespark.plans import model_queries as Q

    assert "lineitem" not in plan_of(Q.score_distances(spark, sf)) and "p_brand" not in plan_of(Q.score_distances(spark, sf))
    seen, rows = [], M._Rows
    monkeypatch.setattr(M, "_Rows", lambda cells, *rest: seen.append(plan_of(cells)) or rows(cells, *rest))
    x = np.random.default_rng(8).standard_normal((6, 4))
    t = frame(spark, x).join(spark.range(6).select(F.format_string("p%02d", "id").alias("profile")), "profile")
    assert M.em_svd_pca(t, "value").status.first()["status"] == "PASS"
    assert seen and "Join" not in seen[0]
