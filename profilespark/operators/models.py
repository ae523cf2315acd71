"""Low-rank models, ordinations and trees over profiles.

The data stays distributed as packed rows (one vector per profile, or per feature, whichever makes the vectors shorter).
A pass sends the current small model to the rows and brings back sums; the driver solves a k x k or s x s problem, with s the
shorter side. Beyond ``GRAM_SIDE`` the s x s sum is replaced by subspace iteration, which only ever moves s x k numbers.
Every model is keyed by a group, so all classes are fitted in the same passes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .calls import alpha_name
from .pairs import target_level_mean
from .ranks import positions
from .spectrum import WIDTH, spectra, task_spectra

GRAM_SIDE = 2048
CELLS_PER_TASK = 2_000_000
MOVED_CELLS = 1 << 15
REFRESH = 10


# ---------------------------------------------------------------- packed rows

def _spread(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Row vectors in tasks of about ``CELLS_PER_TASK`` cells, written to the shared checkpoint folder."""
    return cut(df.repartition(max(1, -(-rows * width // CELLS_PER_TASK))))


def usable_features(cells: DataFrame, value: str, min_observed: int, complete: bool) -> DataFrame:
    """(group, feature_id, feature_order) of features observed often enough and not constant."""
    v = F.col(value)
    sizes = cells.groupBy("grp").agg(F.countDistinct("profile").alias("_m"))
    stats = cells.where(v.isNotNull()).groupBy("grp", "feature_id", "feature_order").agg(F.count(v).alias("_n"), F.max(v).alias("_hi"), F.min(v).alias("_lo"), F.stddev_pop(v).alias("_sd"))
    kept = stats.join(F.broadcast(sizes), "grp").where((F.col("_hi") > F.col("_lo")) & (F.col("_sd") > 1e-12))
    kept = kept.where(F.col("_n") == F.col("_m")) if complete else kept.where(F.col("_n") >= min_observed)
    return kept.select("grp", "feature_id", "feature_order")


class _Rows:
    """Packed rows of all groups: key, index lists per group, and which side the vectors run along."""

    def __init__(self, cells: DataFrame, value: str, min_observed: int, complete: bool):
        feats = usable_features(cells, value, min_observed, complete)
        live = cells.join(feats.select("grp", "feature_id"), ["grp", "feature_id"], "left_semi")
        roster = cells.select("grp", "profile").distinct()
        size = roster.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).join(feats.groupBy("grp").agg(F.count(F.lit(1)).alias("f")), "grp", "left")
        self.size = {r["grp"]: (r["m"], r["f"] or 0) for r in size.collect()}
        m, f = max((a for a, _ in self.size.values()), default=0), max((b for _, b in self.size.values()), default=0)
        self.by_profile = f <= m
        rows_of, along = ("profile", "feature_id") if self.by_profile else ("feature_id", "profile")
        names = (feats if self.by_profile else roster).select("grp", F.col(along).alias("name")).orderBy("grp", "name").toPandas()
        self.names = {g: list(d["name"]) for g, d in names.groupby("grp", sort=False)}
        short = feats if self.by_profile else roster
        pos = short.select("grp", F.col(along).alias("_name"))
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pos.schema) + ", _pos int"
        # Position along the short side, from the sorted names the driver already holds.
        index = {g: {n: i for i, n in enumerate(v)} for g, v in self.names.items()}
        pairs = [(g, n, i) for g, d in index.items() for n, i in d.items()]
        lookup = cells.sparkSession.createDataFrame(pairs, ddl) if pairs else pos.withColumn("_pos", F.lit(0))
        placed = live.where(F.col(value).isNotNull()).join(lookup, (live["grp"] == lookup["grp"]) & (live[along] == lookup["_name"])).select(
            live["grp"], F.col(rows_of).alias("key"), "_pos", F.col(value).cast("double").alias("_v"))
        packed = placed.groupBy("grp", "key").agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("_c"))
        packed = packed.select("grp", "key", F.col("_c._pos").alias("pos"), F.col("_c._v").alias("val"))
        if self.by_profile:  # a profile without any usable cell still has a row
            packed = roster.withColumnRenamed("profile", "key").join(packed, ["grp", "key"], "left").select(
                "grp", "key", F.coalesce("pos", F.array().cast("array<int>")).alias("pos"), F.coalesce("val", F.array().cast("array<double>")).alias("val"))
        total = sum((a if self.by_profile else b) for a, b in self.size.values())
        packed = packed.withColumn("fill", F.array().cast("array<double>"))
        self.frame = _spread(packed, total, min(m, f) or 1)
        self.key_type = packed.schema["key"].dataType.simpleString()
        self.grp_type = packed.schema["grp"].dataType.simpleString()


def _matrix(pdf: pd.DataFrame, width: int):
    """(values with NaN at missing cells, filled copy) of one group's rows of a batch."""
    x = np.full((len(pdf), width), np.nan)
    for i, (p, v) in enumerate(zip(pdf["pos"], pdf["val"])):
        x[i, np.asarray(p, dtype=np.int64)] = np.asarray(v, dtype=float)
    return x


def _replay(pdf, g, width, by_profile, start, history):
    """Rows of a group with their missing cells filled by the models fitted so far; also the last two fillings."""
    x = _matrix(pdf, width)
    gone = ~np.isfinite(x)
    if by_profile:
        base = np.broadcast_to(start[g], x.shape)
    else:
        n = np.maximum((~gone).sum(1), 1)
        base = np.broadcast_to((np.where(gone, 0, x).sum(1) / n)[:, None], x.shape)
    filled = np.where(gone, base, x)
    stored = [np.asarray(f, dtype=float) for f in pdf["fill"]]
    for i, f in enumerate(stored):
        if len(f):
            filled[i, gone[i]] = f
    before = filled
    for mean, basis in history.get(g, []):
        mu = mean if by_profile else filled.mean(1, keepdims=True)
        before = filled
        back = mu + ((filled - mu) @ basis) @ basis.T
        filled = np.where(gone, back, x)
    return x, gone, filled, before


def _pass(rows: _Rows, widths, start, history, probe):
    """One distributed pass: sums for the next model, with the change made by the last filling."""
    by_profile = rows.by_profile

    def sums(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby("grp", sort=False):
                if g not in widths:
                    continue
                x, gone, filled, before = _replay(part, g, widths[g], by_profile, start, history)
                c = filled - (start[g] if by_profile else filled.mean(1, keepdims=True))  # sums around the start means lose no digits
                v = probe.get(g)
                a = c.T @ (c @ v) if v is not None else c.T @ c
                head = np.array([len(c), (c * c).sum(), ((filled - before)[gone] ** 2).sum(), (before[gone] ** 2).sum(), gone.sum()])
                new = [head, c.sum(0), a]
                acc[g] = [p + q for p, q in zip(acc[g], new)] if g in acc else new
        for g, (head, s, a) in acc.items():
            yield pd.DataFrame({"grp": [g], "head": [head], "s": [s], "a": [a.ravel()]})

    schema = f"grp {rows.grp_type}, head array<double>, s array<double>, a array<double>"
    return _tree_sum(rows.frame.select("grp", "key", "pos", "val", "fill").mapInPandas(sums, schema), schema)


def _tree_sum(parts: DataFrame, schema: str, fan: int = 32) -> dict:
    """Element-wise sum of partial sums per group, by rounds of at most ``fan`` partials per task."""
    def add(batches):
        acc = {}
        for pdf in batches:
            for g, h, s, a in zip(pdf["grp"], pdf["head"], pdf["s"], pdf["a"]):
                new = [np.asarray(h), np.asarray(s), np.asarray(a)]
                acc[g] = [p + q for p, q in zip(acc[g], new)] if g in acc else new
        for g, (h, s, a) in acc.items():
            yield pd.DataFrame({"grp": [g], "head": [h], "s": [s], "a": [a]})

    n = parts.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInPandas(add, schema)
    out = {}
    for r in parts.collect():
        new = [np.asarray(r["head"]), np.asarray(r["s"]), np.asarray(r["a"])]
        out[r["grp"]] = [p + q for p, q in zip(out[r["grp"]], new)] if r["grp"] in out else new
    return out


def _solve(head, s, gram, by_profile, start):
    """Mean, falling squared singular values, axes and rank from one group's sums around ``start``.

    A value that the rounding of the sums alone could make does not count towards the rank.
    """
    n, off = head[0], s / head[0]
    if by_profile:
        gram = gram - n * np.outer(off, off)
    w, q = np.linalg.eigh(gram)
    w, q = np.maximum(w[::-1], 0.0), q[:, ::-1]
    rank = int((w > 4 * np.finfo(float).eps * max(n, len(w)) * max(w[0], 1e-300)).sum()) if w[0] > 1e-24 else 0
    return (off + start if by_profile else off), w, q, int(min(rank, n - 1 if by_profile else len(w) - 1))


def _advance(rows, widths, start, k, max_iter, tol):
    """The filling rounds of all groups of at most CELLS_PER_TASK cells, each inside one task, up to the last round but one.

    The same rounds as by passes: those work on groups of any size, and make the last ones of every group. Rows come back with their filling and
    the rounds made.
    """
    by_profile = rows.by_profile
    small = {g for g in widths if widths[g] * (rows.size[g][0] if by_profile else rows.size[g][1]) <= CELLS_PER_TASK}
    if not small or max_iter < 2:
        return {}
    columns = ["grp", "key", "pos", "val", "fill"]

    def settle(pdf):
        g = pdf["grp"].iloc[0]
        pdf = pdf.sort_values("key")
        x, gone, filled, _ = _replay(pdf, g, widths[g], by_profile, start, {})
        made, before = 0, filled
        while made < max_iter and gone.any():
            c = filled - (start[g] if by_profile else filled.mean(1, keepdims=True))
            mean, w, q, rank = _solve(np.array([len(c)]), c.sum(0), c.T @ c, by_profile, start.get(g))
            basis = q[:, : min(k, rank)]
            mu = mean if by_profile else filled.mean(1, keepdims=True)
            new = np.where(gone, mu + ((filled - mu) @ basis) @ basis.T, x)
            made, before = made + 1, filled
            change = np.sqrt(((new - filled)[gone] ** 2).mean()) / max(np.sqrt((filled[gone] ** 2).mean()), 1e-12)
            filled = new
            if change <= tol:
                break
        return pdf.assign(fill=[before[i, gone[i]] for i in range(len(pdf))], made=max(0, made - 1))[[*columns, "made"]]

    schema = f"grp {rows.grp_type}, key {rows.key_type}, pos array<int>, val array<double>, fill array<double>"
    mine = rows.frame.where(F.col("grp").isin(*small))
    done = cut(mine.groupBy("grp").applyInPandas(settle, f"{schema}, made long"))
    made = {r["grp"]: r["n"] for r in done.groupBy("grp").agg(F.max("made").alias("n")).collect()}
    rest = rows.frame.where(~F.col("grp").isin(*small))
    rows.frame = done.drop("made") if len(small) == len(rows.size) else done.drop("made").unionByName(rest)
    return {g: n for g, n in made.items() if n}


def _spectrum(rows: _Rows, got, widths, start, history, subspace, k, loose):
    """Mean, top-k basis and squared singular values per group from one pass (or a few, for wide groups)."""
    solved = {}
    wide = {g: subspace[g] for g in got if g in subspace}
    for g, (head, s, a) in got.items():
        if g in wide:
            continue
        mean, w, q, rank = _solve(head, s, a.reshape(widths[g], widths[g]), rows.by_profile, start.get(g))
        solved[g] = (mean, q[:, : min(k, rank)], w[: min(k, rank)], w.sum(), rank)
    for _ in range(200 if wide else 0):
        parts = _pass(rows, {g: widths[g] for g in wide}, start, history, wide)
        moved = 0.0
        for g, (head, s, a) in parts.items():
            off = s / head[0]
            mean = off + start[g] if rows.by_profile else off
            z = a.reshape(widths[g], -1)
            if rows.by_profile:
                z = z - head[0] * np.outer(off, off @ wide[g])
            v = wide[g]
            t = v.T @ z
            ev, turn = np.linalg.eigh((t + t.T) / 2)
            ev, turn = ev[::-1][:k], turn[:, ::-1][:, :k]
            ritz = v @ turn
            moved = max(moved, np.linalg.norm(z @ turn - ritz * ev) / max(ev[0], 1e-300))
            total = head[1] - (head[0] * (off @ off) if rows.by_profile else 0.0)
            wide[g] = np.linalg.qr(z)[0]
            solved[g] = (mean, ritz, np.maximum(ev, 0.0), total, -1)
        if moved < 1e-11:
            break
    else:
        loose.update(wide)
    subspace.update(wide)
    return solved


class Model:
    """scores, loadings and status DataFrames of a fit."""

    def __init__(self, scores, loadings, status):
        self.scores, self.loadings, self.status = scores, loadings, status


_STATUS = ("analysis_id {g}, representation string, method string, status string, reason string, sample_count long, feature_count long, rank long, "
           "component_count long, explained_variance_sum double, iterations long, converged boolean, observed_reconstruction_rmse double")


def _status_row(g, representation, method, status="NOT_ESTIMABLE", reason="", m=None, f=None, rank=None, comps=None, ev=None, it=None, conv=None, rmse=None):
    return (g, representation, method, status, reason, m, f, rank, comps, ev, it, conv, rmse)


def em_svd_pca(profiles: DataFrame, value: str, k: int = 2, min_observed: int = 2, max_iter: int = 300, tol: float = 1e-8, group: str | None = None,
               representation: str = "common", method: str = "EM_SVD_MISSINGNESS_AWARE_PCA", complete: bool = False) -> Model:
    """PCA with missing cells: start from feature means, refill the missing cells from the rank-k fit until they settle.

    Observed cells are never altered. A fit that has not settled after ``max_iter`` is kept with PASS_WITH_LIMITATION. A
    group too small to fit becomes a NOT_ESTIMABLE row. Signs make the largest loading of an axis positive.
    """
    spark = profiles.sparkSession
    cells = cut(profiles.select((F.col(group) if group else F.lit("ALL")).alias("grp"), "profile", "feature_id", "feature_order", value))  # read by several passes
    rows = _Rows(cells, value, min_observed, complete)
    need_rows, need_features = (2, 1) if complete else (3, 2)
    widths, failed = {}, []
    for g, (m, f) in rows.size.items():
        if m < need_rows or f < need_features:
            failed.append(_status_row(g, representation, method, reason="too few profiles or varying features", m=m, f=f))
        else:
            widths[g] = f if rows.by_profile else m
    start = {}
    if rows.by_profile and widths:
        means = cells.where(F.col(value).isNotNull()).groupBy("grp", "feature_id").agg(F.avg(value).alias("mu"))
        kept = usable_features(cells, value, min_observed, complete).select("grp", "feature_id")
        got = means.join(kept, ["grp", "feature_id"], "left_semi").toPandas()
        for g, d in got.groupby("grp", sort=False):
            mu = dict(zip(d["feature_id"], d["mu"]))
            start[g] = np.array([mu[n] for n in rows.names[g]])
    rng = np.random.default_rng(0)
    subspace = {g: np.linalg.qr(rng.standard_normal((w, min(k + 4, w))))[0] for g, w in widths.items() if w > GRAM_SIDE}
    history: dict = {g: [] for g in widths}
    active, fits = dict(widths), {}
    ahead = _advance(rows, {g: w for g, w in widths.items() if g not in subspace}, start, k, max_iter, tol)
    iterations, settled = {g: ahead.get(g, 0) for g in widths}, {g: False for g in widths}
    stale, unsettled = 0, {}
    while active:
        got = _pass(rows, active, start, history, subspace)
        loose = {}
        solved = _spectrum(rows, got, active, start, history, subspace, k, loose)
        unsettled.update({g: g in loose for g in active})
        for g in list(active):
            head = got[g][0]
            if history[g]:
                change = np.sqrt(head[2] / head[4]) / max(np.sqrt(head[3] / head[4]), 1e-12) if head[4] else 0.0
                settled[g] = bool(change <= tol)
            fits[g] = solved[g]
            if settled[g] or iterations[g] >= max_iter:
                active.pop(g)
                continue
            mean, basis = solved[g][:2]
            history[g].append((mean, basis))
            iterations[g] += 1
            if head[4] == 0:
                settled[g] = True
                active.pop(g)
        stale += 1
        if stale >= REFRESH and active:
            # The newest model stays out of the stored filling, so that the next pass still sees what it changed.
            rows.frame = _store(rows, widths, start, {g: h[:-1] for g, h in history.items()})
            history = {g: h[-1:] for g, h in history.items()}
            stale = 0
    scores, loadings, rmse = _tables(rows, widths, start, history, fits, k)
    status = []
    for g in widths:
        mean, basis, w, total, rank = fits[g]
        m, f = rows.size[g]
        comps = min(k, rank) if rank >= 0 else k
        ok = settled[g] and not unsettled[g]
        status.append(_status_row(g, representation, method, "PASS" if ok else "PASS_WITH_LIMITATION", "" if ok else "axes not settled within the pass limit; estimate kept" if unsettled[g] else "not settled within the iteration limit; estimate kept",
                                  m, f, rank if rank >= 0 else None, comps, float(w[:comps].sum() / total) if total > 0 else 0.0, iterations[g], ok, rmse.get(g)))
    st = spark.createDataFrame(status + failed, _STATUS.format(g=rows.grp_type))
    return Model(scores, loadings, st)


def _store(rows: _Rows, widths, start, history) -> DataFrame:
    """Current fillings written out, so that later passes replay only what came after."""
    by_profile = rows.by_profile

    def keep(batches):
        for pdf in batches:
            out = []
            for g, part in pdf.groupby("grp", sort=False):
                if g in widths:
                    _, gone, filled, _ = _replay(part, g, widths[g], by_profile, start, history)
                    part = part.assign(fill=[filled[i, gone[i]] for i in range(len(part))])
                out.append(part)
            yield pd.concat(out) if out else pdf

    schema = f"grp {rows.grp_type}, key {rows.key_type}, pos array<int>, val array<double>, fill array<double>"
    return cut(rows.frame.mapInPandas(keep, schema))


def _tables(rows: _Rows, widths, start, history, fits, k):
    """Scores and loadings: one side is on the driver, the other is worked out row by row."""
    spark = rows.frame.sparkSession
    by_profile = rows.by_profile
    comps = [f"PC{i + 1}" for i in range(k)]
    plan = {g: (fits[g][0], fits[g][1], np.sqrt(np.maximum(fits[g][2], 0.0))) for g in widths}

    def project(batches):
        for pdf in batches:
            for g, part in pdf.groupby("grp", sort=False):
                if g not in plan:
                    continue
                mean, basis, sv = plan[g]
                x, gone, filled, _ = _replay(part, g, widths[g], by_profile, start, history)
                mu = mean if by_profile else filled.mean(1, keepdims=True)
                y = (filled - mu) @ basis
                res = np.where(gone, 0.0, filled - mu - y @ basis.T)
                out = y if by_profile else y / np.where(sv > 0, sv, 1.0)[: basis.shape[1]]
                d = {"grp": part["grp"].to_numpy(), "key": part["key"].to_numpy()}
                for i, c in enumerate(comps):
                    d[c] = out[:, i] if i < out.shape[1] else np.full(len(out), np.nan)
                d["row_mean"] = filled.mean(1)
                d["sq"], d["n_obs"] = (res * res).sum(1), (~gone).sum(1)
                yield pd.DataFrame(d)

    schema = f"grp {rows.grp_type}, key {rows.key_type}, " + ", ".join(f"{c} double" for c in comps) + ", row_mean double, sq double, n_obs long"
    far = cut(rows.frame.mapInPandas(project, schema)) if widths else spark.createDataFrame([], schema)
    rmse = {r["grp"]: float(np.sqrt(r["s"] / r["n"])) for r in far.groupBy("grp").agg(F.sum("sq").alias("s"), F.sum("n_obs").alias("n")).collect() if r["n"]}
    near = []
    for g in widths:
        mean, basis, sv = plan[g]
        for i, name in enumerate(rows.names[g]):
            near.append((g, name, float(mean[i]) if by_profile else None, *[float(basis[i, c] * (1.0 if by_profile else sv[c])) if c < basis.shape[1] else None for c in range(k)]))
    name_type = "string" if by_profile else rows_name_type(rows)
    nearf = spark.createDataFrame(near, f"grp {rows.grp_type}, key {name_type}, row_mean double, " + ", ".join(f"{c} double" for c in comps))
    loads, scores = (nearf, far.drop("sq", "n_obs")) if by_profile else (far.drop("sq", "n_obs"), nearf)
    sign = loads.groupBy("grp").agg(*[F.signum(F.max_by(c, F.abs(c))).alias(f"_s{c}") for c in comps])
    share = spark.createDataFrame([(g, *[float(fits[g][2][i] / fits[g][3]) if i < len(fits[g][2]) and fits[g][3] > 0 else None for i in range(k)]) for g in widths] or [],
                                  f"grp {rows.grp_type}, " + ", ".join(f"{c}_variance_fraction double" for c in comps))
    flip = [(F.col(c) * F.col(f"_s{c}")).alias(c) for c in comps]
    sc = scores.join(F.broadcast(sign), "grp").join(F.broadcast(share), "grp").select(F.col("grp").alias("analysis_id"), F.col("key").alias("profile"), *flip, *[f"{c}_variance_fraction" for c in comps])
    ld = loads.join(F.broadcast(sign), "grp").select(F.col("grp").alias("analysis_id"), F.col("key").alias("feature_id"), F.col("row_mean").alias("mean"), 
                                                    *[(F.col(c) * F.col(f"_s{c}")).alias(f"{c}_loading") for c in comps])
    return sc, ld, rmse


def rows_name_type(rows: _Rows) -> str:
    first = next((v[0] for v in rows.names.values() if v), "")
    return "string" if isinstance(first, str) else "bigint"


def complete_case_pca(profiles: DataFrame, value: str, k: int = 2, group: str | None = None, representation: str = "common") -> Model:
    """PCA on the features every profile of the group has; nothing is filled."""
    return em_svd_pca(profiles, value, k, 2, 1, 0.0, group, representation, "COMPLETE_CASE_SVD_PCA", complete=True)


def target_level_pca(profiles: DataFrame, value: str, complete: bool = False, max_iter: int = 300) -> Model:
    means = target_level_mean(profiles, value)
    if complete:
        return complete_case_pca(means, value, representation="target_mean")
    return em_svd_pca(means, value, representation="target_mean", method="TARGET_LEVEL_EM_SVD_PCA", max_iter=max_iter)


def sparse_call_pca(states: DataFrame, alpha: float, max_iter: int = 300, group: str | None = None) -> Model:
    """PCA of the 1 / 0 / NULL cells of features called by anybody in the group."""
    c = f"call_{alpha_name(alpha)}"
    keys = [group, "feature_id"] if group else ["feature_id"]
    union = states.where(F.col(c) == 1).select(*keys).distinct()
    live = states.join(union, keys, "left_semi").withColumn("_call", F.col(c).cast("double"))
    return em_svd_pca(live, "_call", max_iter=max_iter, group=group, representation=f"{alpha_name(alpha)}_binary_0_1_NA", method="SUPPORT_AWARE_SPARSE_FINGERPRINT_EM_SVD_PCA")


# ---------------------------------------------------------------- projection on fixed axes

def project_rows(profiles: DataFrame, loadings: DataFrame, value: str, max_condition: float = 1e8) -> DataFrame:
    """Least squares of partly observed profiles on two fixed axes, as sums per profile.

    ``loadings``: feature_id, mean, PC1_loading, PC2_loading. The second axis is first cleared of the first on the profile's
    own cells, so the conditioning test does not suffer from squaring.
    """
    l1, l2 = F.col("PC1_loading"), F.col("PC2_loading")
    rows = profiles.where(F.col(value).isNotNull()).join(loadings, "feature_id").withColumn("_c", F.col(value) - F.col("mean"))
    first = rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.sum(l1 * l1).alias("s11"), F.sum(l1 * l2).alias("s12"), F.sum(l2 * l2).alias("s22"))
    slope = F.coalesce(F.try_divide(F.col("s12"), F.col("s11")), F.lit(0.0))
    second = rows.join(first.select("profile", slope.alias("_t")), "profile").withColumn("_o", l2 - F.col("_t") * l1)
    sums = second.groupBy("profile").agg(F.sum(F.col("_o") * F.col("_o")).alias("soo"), F.sum(l1 * F.col("_c")).alias("b1"), F.sum(F.col("_o") * F.col("_c")).alias("bo"),
                                         F.sum(F.col("_c") * F.col("_c")).alias("cc"), F.max("_t").alias("_t"))
    j = profiles.select("profile").distinct().join(first, "profile", "left").join(sums, "profile", "left")
    half, diff = (F.col("s11") + F.col("s22")) / 2, (F.col("s11") - F.col("s22")) / 2
    top = half + F.sqrt(diff * diff + F.col("s12") * F.col("s12"))
    j = j.withColumn("_top", top).withColumn("_low", F.try_divide(F.col("s11") * F.col("soo"), F.col("_top")))
    cond = F.sqrt(F.try_divide(F.col("_top"), F.col("_low")))
    n = F.coalesce("n", F.lit(0))
    deficient = F.col("_low").isNull() | (F.sqrt("_low") <= F.sqrt("_top") * F.greatest(n, F.lit(2)) * 2.220446049250313e-16)
    status = F.when(n < 3, "NOT_ESTIMABLE_INSUFFICIENT_OBSERVED_FEATURES").when(deficient, "NOT_ESTIMABLE_RANK_DEFICIENT").when(cond > max_condition, "NOT_ESTIMABLE_ILL_CONDITIONED").otherwise("ESTIMATED")
    j = j.withColumn("status", status)
    ok = F.col("status") == "ESTIMATED"
    y2 = F.try_divide(F.col("bo"), F.col("soo"))
    y1 = F.try_divide(F.col("b1"), F.col("s11")) - y2 * F.col("_t")
    left = F.col("cc") - F.col("b1") * F.try_divide(F.col("b1"), F.col("s11")) - F.col("bo") * y2
    return j.select("profile", n.alias("observed_features"), "status", F.when(ok, y1).alias("PC1"), F.when(ok, y2).alias("PC2"),
                    F.when(ok, cond).alias("condition_number"), F.when(ok, F.sqrt(F.greatest(left, F.lit(0.0)) / n)).alias("projection_rmse"))


def fixed_reference_pca(profiles: DataFrame, value: str, reference: DataFrame, queries: DataFrame, max_iter: int = 300, representation: str = "common") -> Model:
    """Axes from the reference profiles only; query profiles are projected and never move them."""
    method = "FROZEN_REFERENCE_EM_SVD_PCA_WITH_WLS_QUERY_PROJECTION"
    fit = em_svd_pca(profiles.join(reference.select("profile").distinct(), "profile", "left_semi"), value, max_iter=max_iter, representation=representation, method=method)
    asked = profiles.join(queries.select("profile").distinct(), "profile", "left_semi")
    proj = project_rows(asked, fit.loadings.drop("analysis_id"), value)
    ref = fit.scores.select("profile", "PC1", "PC2", F.lit("REFERENCE").alias("row_role"), F.lit("ESTIMATED").alias("status"))
    both = ref.unionByName(proj.select("profile", "PC1", "PC2", F.lit("PROJECTED_QUERY").alias("row_role"), "status"))
    short = proj.agg(F.count_if(F.col("status") != "ESTIMATED").alias("_bad"))
    status = fit.status.join(F.broadcast(short), F.lit(True))
    reason = F.concat_ws("; ", F.nullif("reason", F.lit("")), F.when(F.col("_bad") > 0, "at least one query projection was not estimable"))
    status = status.withColumn("status", F.when(F.col("_bad") > 0, "PASS_WITH_LIMITATION").otherwise(F.col("status"))).withColumn("reason", reason).withColumnRenamed("_bad", "queries_not_estimable")
    return Model(both, fit.loadings, status)


# ---------------------------------------------------------------- distances

def complete_distance_subset(pairs: DataFrame, coverage: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded in order): drop the profile with most missing distances until none is missing or two profiles are left.

    Ties drop lower coverage, then the smaller name. ``coverage``: profile, coverage.

    A profile that precedes all those it lacks a distance to is dropped before any of them whatever happens elsewhere, as the others' counts
    can only fall. So every round drops all such profiles at once, and the rounds follow the longest chain of precedence instead of the
    number dropped. The counts that profiles are dropped at never rise in the one-at-a-time order, so sorting by that count, coverage and
    name gives that order back.
    """
    names = cut(coverage.select("profile", F.coalesce(F.col("coverage").cast("double"), F.lit(0.0)).alias("_c")))
    edges = cut(pairs.where(F.col(metric).isNull()).select("a", "b").where("a <> b"))
    dropped = None
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array("a", "b")).alias("profile")).groupBy("profile").agg(F.count(F.lit(1)).alias("_n"))
        ends = cut(ends.join(names, "profile", "left").na.fill(0.0, ["_c"]))
        x, y = (ends.select(*[F.col(c).alias(f"{side}{c}") for c in ("profile", "_n", "_c")]) for side in ("x", "y"))
        met = edges.join(x, F.col("a") == F.col("xprofile")).join(y, F.col("b") == F.col("yprofile"))
        first = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & ((F.col("x_c") < F.col("y_c")) | ((F.col("x_c") == F.col("y_c")) & (F.col("a") < F.col("b")))))
        later = met.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("profile")).distinct()
        gone = cut(ends.join(later, "profile", "left_anti"))
        dropped = gone if dropped is None else cut(dropped.unionByName(gone))
        gone = gone.select("profile")
        edges = cut(edges.join(gone, F.col("a") == F.col("profile"), "left_anti").join(gone, F.col("b") == F.col("profile"), "left_anti"))
    if dropped is None:
        return coverage, coverage.select(F.lit(0).cast("long").alias("exclusion_order"), "profile").limit(0)
    most = max(0, names.count() - 2)
    placed = positions(dropped, [F.desc("_n"), "_c", "profile"], "exclusion_order").where(F.col("exclusion_order") <= most)
    excluded = cut(placed.select("exclusion_order", "profile"))
    return coverage.join(excluded, "profile", "left_anti"), excluded


def double_center(distances: DataFrame, group: str | None = None) -> DataFrame:
    """-1/2 J D^2 J of a full symmetric long matrix (a, b, value)."""
    keys = [group] if group else []
    sq = distances.withColumn("_q", F.col("value") * F.col("value"))
    row = sq.groupBy(*keys, "a").agg(F.avg("_q").alias("_r"))
    col = row.select(*keys, F.col("a").alias("b"), F.col("_r").alias("_s"))
    grand = row.groupBy(*keys).agg(F.avg("_r").alias("_g"))
    j = sq.join(row, keys + ["a"]).join(col, keys + ["b"])
    j = j.join(F.broadcast(grand), keys) if keys else j.join(F.broadcast(grand), F.lit(True))
    return j.select(*keys, "a", "b", (-(F.col("_q") - F.col("_r") - F.col("_s") + F.col("_g")) / 2).alias("value"))


def _row_vectors(long: DataFrame):
    """Packed rows (grp, key, idx, pos, val) of a square long matrix, and the sorted names per group."""
    spark = long.sparkSession
    names = long.select("grp", "a").distinct().orderBy("grp", "a").toPandas()
    index = {g: list(d["a"]) for g, d in names.groupby("grp", sort=False)}
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select("grp", "a").schema) + ", _i int"
    look = spark.createDataFrame([(g, n, i) for g, v in index.items() for i, n in enumerate(v)], ddl)
    other = look.select("grp", F.col("a").alias("b"), F.col("_i").alias("_j"))
    placed = long.join(look, ["grp", "a"]).join(other, ["grp", "b"])
    packed = placed.groupBy("grp", "_i").agg(F.array_sort(F.collect_list(F.struct("_j", "value"))).alias("_c")).select("grp", "_i", F.col("_c._j").alias("pos"), F.col("_c.value").alias("val"))
    n = sum(len(v) for v in index.values())
    return _spread(packed, n, max((len(v) for v in index.values()), default=1)), index


def _shapes(d: DataFrame) -> dict:
    """Per group the number of profiles, and why its distances cannot be scaled (None if they can).

    The two orders of a pair meet in one aggregate; the names of either side are few.
    """
    v = F.col("value")
    pair = d.groupBy("grp", F.least("a", "b").alias("_p"), F.greatest("a", "b").alias("_q")).agg(
        F.count_if(v.isNull()).alias("na"), (F.max((F.col("a") <= F.col("b")).cast("int")) + F.max((F.col("a") > F.col("b")).cast("int"))).alias("orders"),
        F.max(v).alias("hi"), F.min(v).alias("lo"))
    apart = F.col("hi") - F.col("lo") > 1e-9 * F.greatest(F.lit(1.0), F.least(F.abs("hi"), F.abs("lo")))
    size = pair.groupBy("grp").agg(F.sum("na").alias("na"), F.sum("orders").alias("pairs"), F.count_if(apart).alias("uneven"))
    sides = [d.select("grp", F.col(c).alias("name")).distinct().groupBy("grp").agg(F.count("name").alias(n)) for c, n in (("a", "n"), ("b", "m"))]
    out = {}
    for r in size.join(sides[0], "grp").join(sides[1], "grp").collect():
        reason = "fewer than three profiles" if r["n"] < 3 else "incomplete distances" if r["na"] or r["pairs"] != r["n"] * r["n"] or r["m"] != r["n"] else "distances are not symmetric" if r["uneven"] else None
        out[r["grp"]] = (r["n"], reason)
    return out


def _task_groups(sizes: dict) -> tuple[dict, int]:
    """The groups whose square matrices fit a task, and how many tasks to deal them to."""
    small = {g: n for g, n in sizes.items() if n * n <= CELLS_PER_TASK}
    return small, max(1, min(len(small), 4 * -(-sum(n * n for n in small.values()) // CELLS_PER_TASK)))


def pcoa(distances: DataFrame, k: int = 2, group: str | None = None, max_rounds: int = 2000) -> Model:
    """Classical scaling of complete distance matrices (a, b, value, both orders and the diagonal).

    Rank is the number of positive eigenvalues and fractions divide by their sum, at every size: the whole spectrum comes from block
    Lanczos with deflation over the distributed matrix (``spectrum.spectra``), and coordinates are worked out and stay where the rows are.
    Groups of at most ``CELLS_PER_TASK`` cells that ``max_rounds`` cannot stop are solved each inside one task instead.
    An eigenvalue counts as positive above 1e-12 and above what rounding alone could make. A spectrum that is not through after
    ``max_rounds`` is kept with PASS_WITH_LIMITATION, its largest residual as the reason, and no rank or fractions.
    """
    spark = distances.sparkSession
    d = distances.withColumn("grp", F.col(group) if group else F.lit("ALL"))
    shape = _shapes(d)
    sizes = {g: n for g, (n, reason) in shape.items() if reason is None}
    gt, key = d.schema["grp"].dataType.simpleString(), d.schema["a"].dataType.simpleString()
    status = [_status_row(g, "pairwise", "PCOA", reason=reason, m=n) for g, (n, reason) in shape.items() if reason]
    axes = [f"Axis{i + 1}" for i in range(k)]
    names = axes + [f"{a}_variance_fraction" for a in axes]
    empty = spark.createDataFrame([], f"analysis_id {gt}, profile {key}, " + ", ".join(f"{c} double" for c in names))
    if not sizes:
        return Model(empty, None, spark.createDataFrame(status, _STATUS.format(g=gt)))
    gram = cut(double_center(d.where(F.col("grp").isin(list(sizes))).select("grp", "a", "b", "value"), "grp"))
    small, tasks = _task_groups({g: n for g, n in sizes.items() if n <= max_rounds * WIDTH})
    large = {g: n for g, n in sizes.items() if g not in small}
    parts = [task_spectra(gram.where(F.col("grp").isin(list(small))), small, k, tasks)] if small else []
    parts += [spectra(gram.where(F.col("grp").isin(list(large))), large, k, max_rounds)] if large else []
    found, vectors = {g: s for f, _ in parts for g, s in f.items()}, reduce(DataFrame.unionByName, [v for _, v in parts])
    scale = []
    for g, s in found.items():
        n, size = sizes[g], np.abs(s.values).max(initial=0.0)
        w = s.values[s.values > max(1e-12, 4 * n * np.finfo(float).eps * size)]
        comps, total = min(k, len(w)), float(w.sum())
        if comps < 1:
            status.append(_status_row(g, "pairwise", "PCOA", reason="no positive eigenvalue", m=n, it=s.rounds, conv=s.whole))
            continue
        shares = [float(w[i] / total) if i < comps and s.whole else None for i in range(k)]
        scale.append((g, *[float(np.sqrt(w[i])) if i < comps else None for i in range(k)], *shares))
        why = "" if s.whole else f"spectrum not exhausted after {s.rounds} rounds; largest residual {s.residual:.3g}"
        status.append(_status_row(g, "pairwise", "PCOA", "PASS" if s.whole else "PASS_WITH_LIMITATION", why, n, None, len(w) if s.whole else None, comps, sum(x for x in shares if x is not None) if s.whole else None, s.rounds, s.whole))
    st = spark.createDataFrame(status, _STATUS.format(g=gt))
    if not scale:
        return Model(empty, None, st)
    factors = spark.createDataFrame(scale, f"grp {gt}, " + ", ".join(f"_f{i} double" for i in range(k)) + ", " + ", ".join(f"{c} double" for c in names[k:]))
    at = [F.get("v", F.lit(i)) for i in range(k)]
    sign = vectors.groupBy("grp").agg(*[F.signum(F.max_by(v, F.struct(F.round(F.abs(v), 9), F.col("name")))).alias(f"_s{i}") for i, v in enumerate(at)])
    placed = vectors.join(factors, "grp").join(sign, "grp")
    coords = placed.select(F.col("grp").alias("analysis_id"), F.col("name").alias("profile"), *[(v * F.col(f"_f{i}") * F.col(f"_s{i}")).alias(c) for (i, v), c in zip(enumerate(at), axes)], *names[k:])
    return Model(coords, None, st)


def _moved(m: np.ndarray, i: np.ndarray, pts: np.ndarray, n_init: int) -> np.ndarray:
    """New places of the points ``i`` (whose distances are the rows of ``m``) for every start, and their parts of the stresses."""
    out, n = np.empty((len(i), n_init * 3)), len(pts)
    tall = max(1, MOVED_CELLS // n)
    for s in range(n_init):
        p = pts[:, 2 * s: 2 * s + 2]
        px, py = np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1])
        for at in range(0, len(i), tall):  # parts that stay in the cache
            rows = slice(at, at + tall)
            me, own = p[i[rows]], m[rows]
            dist, other = me[:, :1] - px, me[:, 1:] - py
            np.multiply(dist, dist, out=dist)
            np.multiply(other, other, out=other)
            np.add(dist, other, out=dist)
            np.sqrt(dist, out=dist)
            np.subtract(dist, own, out=other)
            out[rows, 2 * n_init + s] = np.einsum("ij,ij->i", other, other) / 2
            dist[dist <= 1e-12] = np.inf  # a point itself, and those at the same place
            ratio = np.divide(own, dist, out=other)
            out[rows, 2 * s: 2 * s + 2] = (me * ratio.sum(1, keepdims=True) - ratio @ p) / n
    return out


def metric_mds(distances: DataFrame, seed: int, n_init: int = 8, max_iter: int = 1000, eps: float = 1e-4, group: str | None = None) -> Model:
    """Two-dimensional metric scaling by stress majorisation, best of ``n_init`` seeded starts.

    The distance rows stay distributed; a pass moves every point of every start at once, and only coordinates (two numbers
    per profile and start) travel. Groups of at most ``CELLS_PER_TASK`` cells make the same rounds each inside one task.
    Accepted by raw stress; coordinates are defined up to rotation.
    """
    spark = distances.sparkSession
    d = distances.withColumn("grp", F.col(group) if group else F.lit("ALL"))
    shape = _shapes(d)
    fine = [g for g, (_, reason) in shape.items() if reason is None]
    rows, index = _row_vectors(d.where(F.col("grp").isin(fine)).select("grp", "a", "b", "value"))
    gt, key = d.schema["grp"].dataType.simpleString(), d.schema["a"].dataType.simpleString()
    names_out = [f"y{i}" for i in range(n_init * 3)]

    def start(n):
        return np.random.default_rng(seed).random((n, n_init * 2))

    def settled(stress, last, made):
        return (last is not None and np.all(last - stress <= eps * np.maximum(last, 1e-300))) or made > max_iter

    small, tasks = _task_groups({g: len(names) for g, names in index.items()})
    best, rounds = {}, dict.fromkeys(index, 0)

    def settle(pdf):
        pdf = pdf.sort_values("_i")
        m = np.vstack([np.asarray(v, dtype=float) for v in pdf["val"]])
        x, last, made, at = start(len(m)), None, 0, np.arange(len(m))
        while True:
            y = _moved(m, at, x, n_init)
            stress, made = y[:, 2 * n_init:].sum(0), made + 1
            if settled(stress, last, made):
                s = int(np.argmin(stress))
                return pd.DataFrame({"grp": pdf["grp"].to_numpy(), "_i": pdf["_i"].to_numpy(), "x": x[:, 2 * s], "y": x[:, 2 * s + 1], "stress": stress[s], "made": made})
            last, x = stress, y[:, : 2 * n_init]

    if small:
        mine = rows.where(F.col("grp").isin(list(small))).select("grp", "_i", "val").repartition(tasks, "grp")
        got = mine.groupBy("grp").applyInPandas(settle, f"grp {gt}, _i int, x double, y double, stress double, made long").toPandas()
        for g, part in got.groupby("grp", sort=False):
            part = part.sort_values("_i")
            best[g], rounds[g] = (part[["x", "y"]].to_numpy(), float(part["stress"].iloc[0])), int(part["made"].iloc[0])

    def move(batches):
        for pdf in batches:
            for g, part in pdf.groupby("grp", sort=False):
                if g not in now:
                    continue
                i = part["_i"].to_numpy()
                res = pd.DataFrame(_moved(np.vstack([np.asarray(v, dtype=float) for v in part["val"]]), i, now[g], n_init), columns=names_out)
                res.insert(0, "_i", i)
                res.insert(0, "grp", g)
                yield res

    moving = set(index) - set(small)
    x, last = {g: start(len(index[g])) for g in moving}, {}
    for _ in range(max_iter + 1):
        if not moving:
            break
        now = {g: x[g] for g in moving}
        got = rows.select("grp", "_i", "val").mapInPandas(move, f"grp {gt}, _i int, " + ", ".join(f"{c} double" for c in names_out)).toPandas()
        for g, part in got.groupby("grp", sort=False):
            y = part.sort_values("_i")[names_out].to_numpy()
            stress = y[:, 2 * n_init:].sum(0)
            rounds[g] += 1
            if settled(stress, last.get(g), rounds[g]):
                s = int(np.argmin(stress))
                best[g] = (x[g][:, 2 * s: 2 * s + 2], float(stress[s]))
                moving.discard(g)
            else:
                last[g], x[g] = stress, y[:, : 2 * n_init]
    coords = [(g, n, float(p[0]), float(p[1])) for g, names in index.items() for n, p in zip(names, best[g][0])]
    status = [(g, "METRIC_MDS", "PASS" if rounds[g] <= max_iter else "PASS_WITH_LIMITATION", len(names), rounds[g], best[g][1], seed) for g, names in index.items()]
    status += [(g, "METRIC_MDS", f"NOT_ESTIMABLE: {reason}", n, None, None, seed) for g, (n, reason) in shape.items() if reason]
    c = spark.createDataFrame(coords, f"analysis_id {gt}, profile {key}, MDS1 double, MDS2 double")
    return Model(c, None, spark.createDataFrame(status, f"analysis_id {gt}, method string, status string, sample_count long, iterations long, stress double, seed long"))


def metric_mds_check(distances: DataFrame, model: Model, tol: float = 1e-6, group: str | None = None) -> DataFrame:
    """Per group the raw stress worked out again from the coordinates by joins, and whether it is what the status says."""
    d = distances.withColumn("grp", F.col(group) if group else F.lit("ALL"))
    c = model.scores
    a = c.select(F.col("analysis_id").alias("grp"), F.col("profile").alias("a"), F.col("MDS1").alias("_x"), F.col("MDS2").alias("_y"))
    b = c.select(F.col("analysis_id").alias("grp"), F.col("profile").alias("b"), F.col("MDS1").alias("_u"), F.col("MDS2").alias("_v"))
    gap = F.sqrt((F.col("_x") - F.col("_u")) ** 2 + (F.col("_y") - F.col("_v")) ** 2)
    again = d.join(a, ["grp", "a"]).join(b, ["grp", "b"]).groupBy("grp").agg((F.sum((gap - F.col("value")) ** 2) / 2).alias("stress_again"), F.count(F.lit(1)).alias("cells"))
    out = model.status.join(again, F.col("analysis_id") == F.col("grp"), "left").drop("grp")
    return out.withColumn("stress_agrees", F.abs(F.col("stress") - F.col("stress_again")) <= tol * F.greatest(F.lit(1.0), F.col("stress")))


def _finish_trees(live: DataFrame, group: str, ready: dict) -> DataFrame:
    """The merges left in the named groups (with their numbers of clusters), each group inside one task: the same rounds on a matrix."""
    kinds = dict(live.dtypes)
    columns = [group, "left_cluster", "right_cluster", "distance", "member_count"]

    def finish(table: pa.Table) -> pa.Table:
        both = pa.concat_arrays([c for side in ("a", "b") for c in table[side].chunks])
        names = pc.unique(both)
        names = names.take(pc.sort_indices(names))
        i, j = (pc.index_in(table[side], names).to_numpy() for side in ("a", "b"))
        s, met, size = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)), bool), np.ones(len(names), np.int64)
        s[i, j] = s[j, i] = table["s"].to_numpy()
        met[i, j] = met[j, i] = True
        size[i], size[j] = table["na"].to_numpy(), table["nb"].to_numpy()
        at, made = np.arange(len(names)), []
        while met.any():
            d = np.where(met, s / np.outer(size, size), np.inf)
            near = d.argmin(1)  # equal distances go to the smaller name
            x = np.flatnonzero((near[near] == np.arange(len(at))) & (np.arange(len(at)) < near) & met[np.arange(len(at)), near])
            y = near[x]
            made.append((at[x], at[y], d[x, y], size[x] + size[y]))
            s[x] += s[y]
            s[:, x] += s[:, y]
            met[x] |= met[y]
            met[:, x] |= met[:, y]
            size[x] += size[y]
            met[x, x] = False
            kept = np.setdiff1d(np.arange(len(at)), y)
            s, met, size, at = s[np.ix_(kept, kept)], met[np.ix_(kept, kept)], size[kept], at[kept]
        left, right, distance, members = (np.concatenate(part) for part in zip(*made))
        return pa.table([pa.repeat(table[group][0], len(left)), names.take(pa.array(left)), names.take(pa.array(right)), pa.array(distance), pa.array(members)], names=columns)

    mine = live.where(F.col(group).isin(list(ready))).repartition(_task_groups(ready)[1], group)
    schema = f"{group} {kinds[group]}, left_cluster {kinds['a']}, right_cluster {kinds['b']}, distance double, member_count bigint"
    return cut(mine.groupBy(group).applyInArrow(finish, schema))


def average_linkage_by_group(distances: DataFrame, group: str) -> DataFrame:
    """Average-linkage tree of every group at once: left, right, distance, member_count; a cluster is named by its smallest member.

    In each round all pairs of clusters that are each other's nearest merge together. For average linkage this gives the tree
    of one-at-a-time merging, because a merge never brings a cluster nearer than its parts were. Rounds are joins and
    aggregates over the cluster pairs, so no large group is ever held by one task; a group whose clusters are few enough for
    ``CELLS_PER_TASK`` cells, from the start or after some rounds, makes its remaining rounds inside one.
    ``distances``: group, a, b, value with a < b, complete.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    live = cut(distances.where(F.col("a") != F.col("b")).select(group, lo.alias("a"), hi.alias("b"), F.col("value").cast("double").alias("s"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")).distinct())
    kinds = dict(live.dtypes)
    merges = live.sparkSession.createDataFrame([], f"{group} {kinds[group]}, left_cluster {kinds['a']}, right_cluster {kinds['b']}, distance double, member_count bigint")
    finite = F.coalesce(F.abs("s") < float("inf"), F.lit(False))
    while not live.isEmpty():
        clusters = live.select(group, F.explode(F.array("a", "b")).alias("c"), finite.alias("f")).groupBy(group, "c").agg(F.min("f").alias("f"))
        fits = clusters.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f")).where(F.col("f") & (F.col("n") * F.col("n") <= CELLS_PER_TASK))
        ready = {r[group]: r["n"] for r in fits.collect() if r[group] is not None}
        if ready:
            merges = merges.unionByName(_finish_trees(live, group, ready))
            live = live.where(~F.col(group).isin(list(ready)))
            if live.isEmpty():
                break
        d = F.col("s") / (F.col("na") * F.col("nb"))
        ranked = live.withColumn("r", F.struct(d.alias("d"), F.col("a").alias("a"), F.col("b").alias("b")))
        ends = ranked.select(group, F.explode(F.array("a", "b")).alias("c"), "r")
        near = ends.groupBy(group, "c").agg(F.min("r").alias("r"))
        both = near.groupBy(group, "r").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select(group, F.col("r.a").alias("a"), F.col("r.b").alias("b"), F.col("r.d").alias("distance"))
        done = cut(both.join(live.select(group, "a", "b", "na", "nb"), [group, "a", "b"]).select(group, F.col("a").alias("left_cluster"), F.col("b").alias("right_cluster"), "distance", (F.col("na") + F.col("nb")).alias("member_count")))
        merges = merges.unionByName(done)
        into = done.select(group, F.col("right_cluster").alias("c"), F.col("left_cluster").alias("to"), "member_count")
        size = done.select(group, F.col("left_cluster").alias("c"), F.col("left_cluster").alias("to"), "member_count")
        moved = into.unionByName(size)
        x = live.join(moved.select(group, F.col("c").alias("a"), F.col("to").alias("ta"), F.col("member_count").alias("ma")), [group, "a"], "left")
        x = x.join(moved.select(group, F.col("c").alias("b"), F.col("to").alias("tb"), F.col("member_count").alias("mb")), [group, "b"], "left")
        x = x.select(group, F.coalesce("ta", "a").alias("p"), F.coalesce("tb", "b").alias("q"), F.coalesce("ma", "na").alias("np"), F.coalesce("mb", "nb").alias("nq"), "s").where("p <> q")
        swap = F.col("p") > F.col("q")
        x = x.select(group, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(swap, F.col("nq")).otherwise(F.col("np")).alias("na"), F.when(swap, F.col("np")).otherwise(F.col("nq")).alias("nb"), "s")
        live = cut(x.groupBy(group, "a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")))
    return merges


def class_models(profiles: DataFrame, states: DataFrame, distances: DataFrame, classes: DataFrame, value: str, alpha: float, max_iter: int = 300, mds_seed: int = 20260813) -> dict[str, DataFrame]:
    """Joint, target-level and sparse-call PCA, classical scaling, metric scaling and average linkage for every class.

    ``distances`` is the full long matrix (a, b, value). All classes share the passes; one that cannot be fitted is a status row.
    """
    member = classes.select("class_id", "profile").distinct()
    mine = cut(profiles.join(member, "profile"))
    joint = em_svd_pca(mine, value, group="class_id", max_iter=max_iter)
    means = mine.groupBy("class_id", "profile", "target").agg(F.avg(value).alias(value)).select(
        "class_id", "profile", F.col("target").alias("feature_id"), F.pmod(F.xxhash64("target"), F.lit(2**62)).alias("feature_order"), value)
    target = em_svd_pca(means, value, group="class_id", representation="target_mean", method="TARGET_LEVEL_EM_SVD_PCA", max_iter=max_iter)
    sparse = sparse_call_pca(cut(states.join(member, "profile")), alpha, max_iter=max_iter, group="class_id")
    a, b = member.select("class_id", F.col("profile").alias("a")), member.select("class_id", F.col("profile").alias("b"))
    inner = cut(distances.join(a, "a").join(b, ["class_id", "b"]).select("class_id", "a", "b", "value"))
    ord_ = pcoa(inner, group="class_id")
    scaled = metric_mds(inner, mds_seed, group="class_id", max_iter=max_iter)
    tree = average_linkage_by_group(inner.where("a < b"), "class_id")
    status = joint.status.unionByName(target.status).unionByName(sparse.status).unionByName(ord_.status)
    return {"scores": joint.scores, "loadings": joint.loadings, "target_scores": target.scores, "sparse_scores": sparse.scores, "pcoa": ord_.scores, "mds": scaled.scores, "mds_status": scaled.status, "linkage": tree, "status": status}
