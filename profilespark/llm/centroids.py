"""Centroid clustering of integer vectors with ns-bounds.

Every vector keeps its cluster, the exact squared distance to that centroid and to the nearest other one, and the rounds in which the two
were worked out. All centroids of past rounds are kept (a round's centroids are k x 64 integers), so a stored distance is loosened by the
norm of the total displacement since its own round, which is never more than the sum of the drifts in between. A vector whose bounds still
part keeps its cluster unseen; otherwise its own distance is worked out anew, and if that does not settle it, all distances are.

One pass a round writes the vectors' state together with the sums of those that moved, so a repeated task never counts twice, and the
centroids are updated exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .vectors import column_sums, limbs, integer_vectors, rows_of, summed, whole

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
SLACK = 1e-9  # bounds are floating point: parted by this share at least, so that rounding never settles a tie
FAR = (1 << 63) - 1  # squared distances from here on have no long
STATE = ["vec_id", "x", "cluster", "upper", "upper_at", "lower", "lower_at"]


def _kind(x: np.ndarray, c: np.ndarray):
    """The type in which squared distances of these vectors are exact."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)), int(np.abs(c.astype(float)).max(initial=0)))
    return np.float64 if most < 1 << 20 else np.int64 if most < 1 << 27 else object


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    kind = _kind(x, c)
    if kind is np.float64:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    a, b = x.astype(kind), c.astype(kind)
    return np.stack([((a - own) ** 2).sum(axis=1) for own in b], axis=1)


def own_distances(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    kind = _kind(x, c)
    kind = np.int64 if kind is np.float64 else kind
    return ((x.astype(kind) - c.astype(kind)[cluster]) ** 2).sum(axis=1)


@dataclass
class Bounds:
    """What a vector remembers: its cluster, two squared distances and the rounds they are of."""

    cluster: np.ndarray
    upper: np.ndarray
    upper_at: np.ndarray
    lower: np.ndarray
    lower_at: np.ndarray
    rescanned: int = 0


def scan(x: np.ndarray, c: np.ndarray, now: int) -> Bounds:
    """Nearest and second nearest centroid of every vector by all distances; ties go to the smaller number."""
    d = distances(x, c)
    row, cluster = np.arange(len(x)), d.argmin(axis=1)
    upper = d[row, cluster].copy()
    d[row, cluster] = FAR
    at = np.full(len(x), now, np.int32)
    return Bounds(cluster.astype(np.int32), upper, at, d.min(axis=1), at.copy(), len(x))


def advance(x: np.ndarray, old: Bounds, history: np.ndarray) -> Bounds:
    """The assignment to the newest centroids; ``history`` holds those of all rounds so far."""
    now, k = len(history) - 1, history.shape[1]
    moved = np.sqrt(((history.astype(float) - history[-1].astype(float)) ** 2).sum(axis=2))  # round, centroid
    others = np.array([[moved[t, np.arange(k) != j].max(initial=0) for j in range(k)] for t in range(now + 1)])
    b = Bounds(*(a.copy() for a in (old.cluster, old.upper, old.upper_at, old.lower, old.lower_at)))
    if _kind(x, history) is object:
        b.upper, b.lower = b.upper.astype(object), b.lower.astype(object)
    lower = np.sqrt(b.lower.astype(float)) * (1 - SLACK) - others[b.lower_at, b.cluster] * (1 + SLACK)
    open_ = np.flatnonzero((np.sqrt(b.upper.astype(float)) + moved[b.upper_at, b.cluster]) * (1 + SLACK) >= lower)
    b.upper[open_], b.upper_at[open_] = own_distances(x[open_], history[-1], b.cluster[open_]), now
    open_ = open_[np.sqrt(b.upper[open_].astype(float)) * (1 + SLACK) >= lower[open_]]
    if open_.size:
        fresh = scan(x[open_], history[-1], now)
        for name in ("cluster", "upper", "upper_at", "lower", "lower_at"):
            getattr(b, name)[open_] = getattr(fresh, name)
        b.rescanned = open_.size
    return b


def _longs(values: np.ndarray) -> pa.Array:
    """Longs; those that do not fit are null."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if v < FAR else None for v in values], pa.int64())


def _restored(batch: pa.RecordBatch, x: np.ndarray, history: np.ndarray) -> Bounds:
    """The remembered state of a batch; a distance that had no long is worked out again from the centroids of its round."""
    cluster, upper_at, lower_at = (batch.column(i).to_numpy() for i in (2, 4, 6))
    upper, lower = batch.column(3), batch.column(5)
    if not upper.null_count and not lower.null_count:
        return Bounds(cluster, upper.to_numpy(), upper_at, lower.to_numpy(), lower_at)
    both = [np.array(c.to_pylist(), object) for c in (upper, lower)]
    for i in np.flatnonzero([a is None or b is None for a, b in zip(*both)]):
        one = x[i : i + 1].astype(object)
        both[0][i] = own_distances(one, history[upper_at[i]].astype(object), cluster[i : i + 1])[0]
        rest = [d for j, d in enumerate(distances(one, history[lower_at[i]].astype(object))[0]) if j != cluster[i]]
        both[1][i] = min(rest, default=FAR)
    return Bounds(cluster, both[0], upper_at, both[1], lower_at)


def _round(batches: Iterator[pa.RecordBatch], history: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    """States after an assignment, and at the end of the task a row per cluster with what its sums gain (or, at last, its summed distances)."""
    k = history.shape[1]
    gain, count = [[0] * (1 if last else WIDTH) for _ in range(k)], [0] * k
    kinds = None
    for batch in batches:
        kinds = batch.schema.field(0).type
        if not batch.num_rows:
            continue
        x = rows_of(batch.column(1), WIDTH)
        before = batch.column(2).to_numpy() if len(history) > 1 else np.full(len(x), -1)
        b = advance(x, _restored(batch, x, history), history) if len(history) > 1 else scan(x, history[-1], 0)
        if last:
            stale = np.flatnonzero(b.upper_at != len(history) - 1)
            b.upper[stale] = own_distances(x[stale], history[-1], b.cluster[stale])
            for j in range(k):
                gain[j][0] += sum(map(int, b.upper[b.cluster == j]))
        else:
            for j in range(k):
                came, went = (b.cluster == j) & (before != j), (b.cluster != j) & (before == j)
                count[j] += int(came.sum()) - int(went.sum())
                gain[j] = [s + p - q for s, p, q in zip(gain[j], column_sums(x[came]), column_sums(x[went]))]
        n, no = len(x), pa.nulls(len(x), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(b.cluster), _longs(b.upper), pa.array(b.upper_at), _longs(b.lower), pa.array(b.lower_at), no], names=[*STATE, "part"])
    if kinds is not None:
        part = pa.array([limbs([*gain[j], count[j]]) for j in range(k)], pa.list_(pa.int64()))
        blank = [pa.nulls(k, t) for t in (kinds, pa.list_(pa.int64()))]
        rest = [pa.nulls(k, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(range(k), pa.int32()), *rest, part], names=[*STATE, "part"])


def starts(vectors: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``1:<vec_id>``; ids that are null come last, equal hashes go by the vector."""
    first = vectors.select("x", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"))
    return [list(r["x"]) for r in first.orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()]


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of exactly 64 finite components.

    Other vectors are left out. Ids may be null, repeated and of any type; each row is a vector of its own. With fewer vectors than clusters
    there are as many clusters as vectors, and an empty table gives an empty result. Integer components beyond the range of a long become
    its nearest end, and distances or sums of distances beyond it are null. The driver holds k centroids per round and their sums.
    """
    spark = vectors.sparkSession
    given = integer_vectors(vectors, SCALE, vec_id, embedding).where(F.size("x") == WIDTH)
    kind = dict(given.dtypes)["vec_id"]
    state = f"vec_id {kind}, x array<long>, cluster int, upper long, upper_at int, lower long, lower_at int, part array<long>"
    now = starts(given, clusters)
    if not now:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table, past = given, [now]
    sums, counts = [[0] * WIDTH for _ in now], [0] * len(now)
    for t in range(rounds + 1):
        history, last = np.array(past, np.int64), t == rounds
        out = cut(table.mapInArrow(lambda b, h=history, e=last: _round(b, h, e), state))
        gained = {j: whole(p) for j, p in summed(out.where(F.col("part").isNotNull()).select("cluster", "part"), "cluster", "part").items()}
        table = out.where(F.col("part").isNull()).select(*STATE)
        if last:
            break
        for j, (*gain, n) in gained.items():
            sums[j], counts[j] = [s + g for s, g in zip(sums[j], gain)], counts[j] + n
        past.append([[s // counts[j] for s in sums[j]] if counts[j] else past[-1][j] for j in range(len(now))])
    inertia = [gained[j][0] for j in range(len(now))]
    fits = [F.lit(v if v < FAR else None).cast("long") for v in (*inertia, sum(inertia))]
    shown = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in past[-1]]
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return table.select("vec_id", "cluster", F.col("upper").alias("distance"), pick(fits[:-1]).alias("cluster_inertia"), fits[-1].alias("inertia"), pick(shown).alias("centroid_sha256"))


def cluster_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by full scans in every round."""
    steps = [f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(CAST(c AS DOUBLE) * 64) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x AS c FROM (SELECT x, sha256('1:' || vec_id) AS h FROM kept ORDER BY h, x LIMIT {clusters}))"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'cluster': cluster}}) AS best FROM
  (SELECT rid, vec_id, x, cluster, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]) AS BIGINT) AS d FROM kept, c{t}) GROUP BY rid)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS (SELECT cluster, coalesce(n.c, o.c) AS c FROM c{t} o LEFT JOIN (SELECT cluster, list(CAST(v AS BIGINT) ORDER BY i) AS c FROM
  (SELECT best.cluster AS cluster, i, floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS v FROM a{t}, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1) n USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.best.cluster AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f ON f.cluster = a.best.cluster"""
