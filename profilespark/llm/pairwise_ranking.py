"""Document quality by Bradley-Terry pairwise ranking.

Every training pair prefers a document labelled good to one labelled bad; the weights minimise the logistic loss of the difference of
their features. A document's strength is its weighted features, and the threshold is a quantile of the strengths of all training documents.
All labelled documents outside the held-out part take part: features, pairs and strengths are tables, and every Newton step adds up its
slope and curvature over the pairs in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import group_positions, positions
from ..session import cut
from .common import by_size, plain, texts, words

PAIRS = 30_000  # pairs at least; the larger class sets their number, so that every document is in one
THRESHOLD = 0.7
N_FEATURES = 256 + 6


def features(batch: list[bytes]) -> np.ndarray:
    """Per text: scaled shares of the 256 byte values, then length, word length, and the shares of distinct words, of words equal to the
    one before, of the most frequent word, and of lines that repeat."""
    out = np.zeros((len(batch), N_FEATURES))
    for row, data in zip(out, batch):
        found = words(data)
        if not found:
            continue
        row[:256] = np.log1p(200 * np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data))
        counts: dict[bytes, int] = {}
        for w in found:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in data.split(b"\n") if x.strip()]
        n = len(found)
        row[256:] = (np.log1p(n), sum(map(len, found)) / n if n else 0, len(counts) / n, sum(map(bytes.__eq__, found[1:], found)) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines))
        row[257] = np.log1p(row[257])
    return out


@dataclass
class Ranking:
    centre: np.ndarray
    weight: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """THRESHOLD at the quantile, and in between as likely as the document wins against one that stands there."""
        margin = np.clip(self.strength(x) - self.threshold, -40, 40) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(margin >= np.log(THRESHOLD / (1 - THRESHOLD)), np.maximum(1 / (1 + np.exp(-margin)), THRESHOLD), np.minimum(1 / (1 + np.exp(-margin)), np.nextafter(THRESHOLD, 0)))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(-1, N_FEATURES)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of one ``i`` added up."""
    i, total = 0, 0.0
    for batch in batches:
        i, total = batch.column(0)[0].as_py(), total + _rows(batch.column(1)).sum(axis=0)
    yield _numbered(np.array(total)[None, :], i)


_added.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def _numbered(rows: np.ndarray, first: int = 0) -> pa.RecordBatch:
    i = np.arange(first, first + len(rows), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "v"])


def _summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The rows that ``part`` makes of the feature rows ``x`` of each batch, added up over all tasks; the driver sees the sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_rows(batch.column(0)))
                total = one if total is None else total + one
        if total is not None:
            yield _numbered(total)

    schema = "i int, v array<double>"
    sums = df.select("x").mapInArrow(run, schema).groupBy("i").applyInArrow(_added, schema).collect()
    return np.array([r.v for r in sorted(sums, key=lambda r: r.i)])


def _newton(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Curvature rows and, as the last row, the slope of the logistic loss of some pairs."""

    def part(d: np.ndarray) -> np.ndarray:
        lose = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        return np.vstack(((d * (lose * (1 - lose))[:, None]).T @ d, -(d.T @ lose)[None, :]))

    return part


def _gap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list((_rows(batch.column(0)) - _rows(batch.column(1))).astype(np.float32)), pa.list_(pa.float32()))], names=["x"])


def preferences(placed: DataFrame, good: int, bad: int) -> DataFrame:
    """Differences ``x`` of the features of a good and a bad document: each document meets others, its place moved on by one a round."""
    pairs = placed.sparkSession.range(max(PAIRS, good, bad)).select(
        (F.col("id") % good).alias("_g"), ((F.col("id") % bad + F.floor(F.col("id") / bad)) % bad).alias("_b"))
    first = placed.where("quality = 1").select((F.col("place") - 1).alias("_g"), F.col("x").alias("_x"))
    second = placed.where("quality = 0").select((F.col("place") - 1).alias("_b"), F.col("x").alias("_y"))
    return pairs.join(first, "_g").join(second, "_b").select("_x", "_y").mapInArrow(_gap, "x array<float>")


def fit(marked: DataFrame, ridge: float = 1e-3, rounds: int = 25) -> Ranking:
    """Newton steps on the mean logistic loss over the pairs of all rows (quality, h, x); without both classes every document gets the
    threshold score."""
    size = {r.quality: r.n for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    good, bad = size.get(1, 0), size.get(0, 0)
    if not good or not bad:
        return Ranking(np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    centre = _summed(marked, lambda x: x.sum(axis=0)[None, :])[0] / (good + bad)
    scale = np.sqrt(_summed(marked, lambda x: ((x - centre) ** 2).sum(axis=0)[None, :])[0] / (good + bad))
    scale[scale < 1e-9] = np.inf
    pairs = cut(preferences(group_positions(marked, ["quality"], ["h"], "place"), good, bad))
    n, w = max(PAIRS, good, bad), np.zeros(N_FEATURES)
    for _ in range(rounds):
        step_of = _newton(w / scale)
        sums = _summed(pairs, step_of) / n
        curve = sums[:-1] / scale[:, None] / scale[None, :] + ridge * np.eye(N_FEATURES)
        step = np.linalg.solve(curve, sums[-1] / scale + ridge * w)
        w = w - step * min(1.0, 5 / np.linalg.norm(step))
        if np.abs(step).max() < 1e-6:
            break
    weight = w / scale
    low = Ranking(centre, weight, 0.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(low.strength(_rows(batch.column(0))))], names=["s"])

    ordered = positions(cut(marked.select("x").mapInArrow(strengths, "s double")), ["s"], "at")
    around = ordered.where(F.col("at").between(bad - 1, bad + 1)).agg(F.avg("s").alias("s")).first().s
    return Ranking(centre, weight, float(around))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fits on all labelled documents outside the held-out part."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kind = dict(docs.dtypes)["doc_id"]
    seen = docs.where("doc_id is not null").where(~held_out()).select("doc_id", "text").mapInArrow(_packed, f"doc_id {kind}, at binary, v binary")
    rows = seen.join(marks.hint("merge"), "doc_id").select(F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"), "at", "v")
    return fit(cut(rows.mapInArrow(_unpacked, "quality int, h long, x array<float>")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features that are not zero, by their numbers: what meets the labels is far smaller than the texts."""
    for batch in by_size(batches, "text"):
        x = features(texts(batch, "text")).astype(np.float32)
        at = [np.flatnonzero(row).astype("<u2") for row in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([row[i].astype("<f4").tobytes() for row, i in zip(x, at)], pa.binary())], names=["doc_id", "at", "v"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.zeros((batch.num_rows, N_FEATURES), np.float32)
        for row, at, v in zip(x, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            row[np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f4")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["quality", "h", "x"])


def _scores(batches: Iterator[pa.RecordBatch], ranking) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text"):
        score = ranking.value.score(features(texts(batch, "text")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (1 if the score reaches 0.7).

    Only the text enters a score. Null texts read as empty, and empty ones are scored like any other. Repeated rows give repeated
    scores; a null id is scored and not held out; an empty table gives an empty result; null labels are ignored, of contradicting ones
    the lower counts. Without both labels every score is 0.7.
    """
    source = plain(docs, doc_id=doc_id, text=text)
    ranking = docs.sparkSession.sparkContext.broadcast(learn(source, plain(labels, doc_id=doc_id, quality="quality")))
    kind = dict(source.dtypes)["doc_id"]
    return source.withColumn("held_out", held_out()).mapInArrow(lambda batches: _scores(batches, ranking), f"doc_id {kind}, held_out boolean, score double, predicted int")
