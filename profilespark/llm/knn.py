"""Exact top-k search by inner product as a Voronoi join.

Pivots are drawn from the data, their number following its size. Every data row belongs to the cell of its nearest pivot; a cell is
summarised by its radius, its largest norm and its number of rows. Queries are grouped by the nearest of the first pivots. Each query first
scores a bounded sample of the data, which gives a score that its k-th best answer cannot be under. As q . x is at most
pivot . q + radius * |q| for every row x of a cell, and at most norm * |q|, a query is sent only to the cells whose bound reaches its score.
For every group and cell that have such queries, these are summarised by their distance from the group's pivot and their lowest score:
q . x is at most pivot . x + distance * |x|, so only the rows whose bound reaches that score are copied to the group. What meets is solved
in blocks of queries and chunks of a cell's rows, and the answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import plain

TOP = 5
PIVOTS, GROUPS, PER_GROUP = 1024, 64, 256  # at most so many cells and query groups; a group for so many queries
SAMPLE = 2048  # data rows that the first bounds are taken from
BLOCK, CHUNK = 1024, 16384  # queries and rows that meet in one task
SLACK = 1e-9  # bounds are floating point: widened by this share so that rounding loses no row
LONG = np.iinfo(np.int64)


def _whole(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matrix(column) -> np.ndarray:
    return _whole(column).astype(np.float64)


def _norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every row, and its distance."""
    at = ((pivots**2).sum(axis=1)[None, :] - 2 * v @ pivots.T).argmin(axis=1)
    return at.astype(np.int32), _norm(v - pivots[at])


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component; rows that are null or hold a null or non-finite component are left out."""
    t = plain(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").try_cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return t.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


class Cells(NamedTuple):
    """Pivots and what is known of the rows that are nearest to each."""

    pivots: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    rows: np.ndarray

    def needed(self, v: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """For every query and cell, whether a row of the cell may reach the query's score."""
        middle, size = v @ self.pivots.T, _norm(v)[:, None]
        bound = np.minimum(middle + size * self.radius, size * self.norm)
        return (self.rows > 0) & (bound + SLACK * (1 + np.abs(middle) + size * (self.radius + self.norm)) >= reached[:, None])


class Pairs(NamedTuple):
    """For every group and cell, the queries of the group that need the cell: how far from the group's pivot, how low a score, how many."""

    far: np.ndarray
    reached: np.ndarray
    queries: np.ndarray


def _in_cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column(1))
            cell, far = _nearest(v, pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(_norm(v))], names=["vec_id", "v", "cell", "far", "norm"])


def _in_groups(batches: Iterator[pa.RecordBatch], cells: Cells, n_groups: int, sample: np.ndarray, sample_ids: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """Queries with their group, their distance from its pivot, a score that at least ``top`` other rows reach, and the cells they need."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
        group, far = _nearest(v, cells.pivots[:n_groups])
        scores = np.where(ids[:, None] == sample_ids[None, :], -np.inf, v @ sample.T)
        reached = np.partition(scores, -top, axis=1)[:, -top] if scores.shape[1] >= top else np.full(len(ids), -np.inf)
        reached = np.where(reached <= LONG.min, -np.inf, np.minimum(reached, LONG.max) * (1 - SLACK * np.sign(reached)))
        needed = [np.flatnonzero(row).astype(np.int32) for row in cells.needed(v, reached)]
        offsets = np.concatenate(([0], np.cumsum([x.size for x in needed]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(needed)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(far), pa.array(reached), lists], names=["vec_id", "v", "group", "far", "reached", "cells"])


def _copies(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, pairs: Pairs) -> Iterator[pa.RecordBatch]:
    """Rows of a cell once for each group whose queries of that cell their bound reaches."""
    for batch in batches:
        v, cell, norm = _matrix(batch.column(1)) if batch.num_rows else None, batch.column(2).to_numpy(), batch.column(4).to_numpy()
        for own in np.unique(cell):
            row = np.flatnonzero(cell == own)
            group = np.flatnonzero(pairs.queries[:, own])
            if not group.size:
                continue
            middle, reach = v[row] @ pivots[group].T, norm[row][:, None] * pairs.far[group, own][None, :]
            at, to = np.nonzero(middle + reach + SLACK * (1 + np.abs(middle) + reach) >= pairs.reached[group, own][None, :])
            if at.size:
                taken = batch.take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(group[to].astype(np.int32)), taken.column(2), taken.column(0), taken.column(1)], names=["group", "cell", "vec_id", "v"])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, held at the ends of a long."""
    size = max(1, q.shape[1]) * max(map(abs, (int(q.min(initial=0)), int(q.max(initial=0))))) * max(map(abs, (int(x.min(initial=0)), int(x.max(initial=0)))))
    if size < 2**53:
        return q.astype(np.float64) @ x.T.astype(np.float64)
    if size < 2**63:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), LONG.min, LONG.max).astype(np.int64)


def _solve(asked: pa.Table, rows: pa.Table, top: int) -> pa.Table:
    """The best ``top`` rows of a chunk for each query of a block."""
    names = ["query_id", "query_hash", "vec_id", "score"]
    kinds = [pa.int64()] * 4
    out: list[list] = [[], [], [], []]
    if asked.num_rows and rows.num_rows:
        key = np.stack((rows["vec_id"].to_numpy(), rows["hash"].to_numpy()), axis=1)
        _, once = np.unique(key, axis=0, return_index=True)
        ids, x, q = key[once, 0], _whole(rows["v"])[once], _whole(asked["v"])
        for at in range(0, len(q), 128):
            scores = _scores(q[at : at + 128], x)
            for own, own_hash, row in zip(asked["vec_id"][at : at + 128].to_pylist(), asked["hash"][at : at + 128].to_pylist(), scores):
                able = np.flatnonzero(ids != own)
                if able.size > top:
                    level = np.partition(row[able], -top)[-top]
                    able = able[row[able] >= level]
                best = able[np.lexsort((ids[able], ~row[able].astype(np.int64)))][:top]
                for column, value in zip(out, ([own] * best.size, [own_hash] * best.size, ids[best].tolist(), row[best].astype(np.int64).tolist())):
                    column += value
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


class Meeting(NamedTuple):
    """Queries and data rows under the keys that they meet in, and the numbers of rows, of groups and of cells."""

    asked: DataFrame
    rows: DataFrame
    n_rows: int
    n_groups: int
    n_cells: int


KEY = ["group", "cell", "block", "chunk"]


def meeting(vectors: DataFrame, every: int = 50, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding") -> Meeting:
    """Queries beside every row that may be one of their answers. The driver holds at most ``SAMPLE`` rows, and three numbers for each of at
    most ``GROUPS`` x ``PIVOTS`` pairs of a group and a cell."""
    raw = quantised(vectors, vec_id, embedding)
    width, n_queries = raw.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_distinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id")))).first()
    filled = raw.select("vec_id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).alias("v"))
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    data = cut(filled.withColumn("nth", first).where(F.col("nth") <= top + 1).drop("nth"))
    n = data.count()
    drawn = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    drawn = list({r.vec_id: r for r in drawn}.values())
    sample = np.array([r.v for r in drawn], np.float64).reshape(len(drawn), width)
    sample_ids = np.array([r.vec_id for r in drawn], np.int64)
    pivots = np.unique(sample, axis=0) if len(drawn) else np.zeros((1, width))
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))][: min(PIVOTS, max(1, int(np.sqrt(n) / 2)))]
    n_groups = max(1, min(GROUPS, -(-n_queries // PER_GROUP), len(pivots)))
    placed = cut(data.mapInArrow(lambda b: _in_cells(b, pivots), "vec_id long, v array<long>, cell int, far double, norm double"))
    cells = Cells(pivots, *(np.zeros(len(pivots)) for _ in range(3)))
    for r in placed.groupBy("cell").agg(F.max("far"), F.max("norm"), F.count("*")).collect():
        cells.radius[r[0]], cells.norm[r[0]], cells.rows[r[0]] = r[1:]
    ask = filled.where(F.col("vec_id") % every == 0).distinct()
    grouped = ask.mapInArrow(lambda b: _in_groups(b, cells, n_groups, sample, sample_ids, top), "vec_id long, v array<long>, group int, far double, reached double, cells array<int>")
    queries = cut(grouped)
    wanted = queries.select("*", F.explode("cells").alias("cell"))
    pairs = Pairs(*(np.zeros((n_groups, len(pivots))) for _ in range(3)))
    for r in wanted.groupBy("group", "cell").agg(F.max("far"), F.min("reached"), F.count("*")).collect():
        pairs.far[r[0], r[1]], pairs.reached[r[0], r[1]], pairs.queries[r[0], r[1]] = r[2:]
    copies = placed.mapInArrow(lambda b: _copies(b, pivots, pairs), "group int, cell int, vec_id long, v array<long>")
    chunks = F.element_at(F.lit([max(1, int(-(-c // CHUNK))) for c in cells.rows]), F.col("cell") + 1)
    blocks = F.element_at(F.lit([max(1, int(-(-c // BLOCK))) for c in pairs.queries.ravel()]), F.col("group") * len(pivots) + F.col("cell") + 1)
    own = lambda df: df.select("group", "cell", "vec_id", "v", F.xxhash64("v").alias("hash"), chunks.alias("chunks"), blocks.alias("blocks"))
    asked = own(wanted).withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    rows = own(copies).withColumns({"chunk": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    return Meeting(asked.drop("chunks", "blocks"), rows.drop("chunks", "blocks"), n, n_groups, len(pivots))


def top_k(vectors: DataFrame, every: int = 50, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by ``every``: its ``top`` other rows of largest integer inner product, ties to the smaller id.

    query_id, rank, vec_id, score. Components become floor(256 x), held at the ends of a long like the scores. Ids are whole numbers: rows
    whose id is null or no number, whose vector is null or has a null or non-finite component take no part. Shorter vectors read as if
    filled with zeros. A row never answers a query of its own id; rows that repeat an id and a vector count once. Of equal vectors only the
    ``top`` + 1 smallest ids can be answers, so no others are sent. Queries without any other row have no rows, an empty table gives an
    empty result.
    """
    met = meeting(vectors, every, top, vec_id, embedding)
    found = met.asked.groupBy(*KEY).cogroup(met.rows.groupBy(*KEY)).applyInArrow(lambda a, b: _solve(a, b, top), "query_id long, query_hash long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH ok AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id AS query_id, v AS qv FROM ok WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(qv, v)]) AS BIGINT) AS score FROM q JOIN ok ON query_id <> vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
