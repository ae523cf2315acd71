"""Best-fit packing of tokenised documents into sequences.

Best-fit decreasing places pieces of equal length one after another, so only the number of pieces of each length decides the plan. The
plan is made from that histogram: a segment tree over the remaining capacities finds the tightest open bins, and a whole run of equal
pieces goes into a whole run of equal bins at once. Histogram, open runs and plan are bounded by the sequence length, not by the data;
each piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import by_size, plain, texts, words

SEQUENCE = 4096
CLOSING_ID = 1
MAX_CACHED, MAX_CHUNK = 600_000, 64  # remembered chunks of one worker, and the longest chunk remembered
TOGETHER = 500  # plain chunks encoded in one call
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+([.,!?;:]+)?")  # one word for every tokenizer that splits at word ends, and one run of marks


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space before it splits words, so a text's ids are those of its chunks one after another; the ids of short
    chunks are remembered. New chunks of letters, with marks after them or not, are encoded many at a time, as the ids that end a word
    show where each chunk ends; wherever their number is not as expected, and for all other chunks, each is encoded alone.
    """

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        plain: list[tuple[bytes, str, int]] = []
        alone: list[bytes] = []
        for chunk in chunks:
            text = chunk.decode(errors="replace")
            match = PLAIN.fullmatch(text)
            plain.append((chunk, text, 1 if match[1] is None else 2)) if match else alone.append(chunk)
        out: dict[bytes, bytes] = {}
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self._ids([" ".join(text for _, text, _ in group) for group in groups])):
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([n for _, _, n in group]) - 1
            if ends.size != last[-1] + 1 or ends[-1] != ids.size:
                alone += [chunk for chunk, _, _ in group]
                continue
            stops = (4 * ends[last]).tolist()
            raw = ids.tobytes()
            out.update((chunk, raw[a:b]) for (chunk, _, _), a, b in zip(group, [0, *stops], stops))
        out.update(zip(alone, (ids.tobytes() for ids in self._ids([c.decode(errors="replace") for c in alone]))))
        return out

    def __call__(self, batch: list[bytes]) -> list[bytes]:
        split = [words(data) for data in batch]
        if len(self.known) > MAX_CACHED:
            self.known.clear()
        fresh = set().union(*split) - self.known.keys()
        self.known.update(self._encode(list(fresh)))
        out = [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]
        for chunk in fresh:
            if len(chunk) > MAX_CHUNK:
                del self.known[chunk]
        return out


@lru_cache(maxsize=1)
def encoder(tokenizer_file: str) -> Encoder:
    """One a worker process, so that later tasks find what earlier ones remembered."""
    return Encoder(tokenizer_file)


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_file: str, size: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode, part, seen = encoder(tokenizer_file), TaskContext.get().partitionId(), {}
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"]
    closing = np.array([CLOSING_ID], "<u4").tobytes()
    for batch in by_size(batches, "text"):
        source, rows = [], []
        for row, ids in enumerate(encode(texts(batch, "text"))):
            ids += closing
            total = len(ids) // 4
            for piece, start in enumerate(range(0, total, size)):
                length = min(size, total - start)
                seq = seen[length] = seen.get(length, -1) + 1
                source.append(row)
                rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seq))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], names=names)


def pieces(docs: DataFrame, tokenizer_file: str, size: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document with their checksum, the task that made them and their rank in it among pieces of their length."""
    source = plain(docs, doc_id=doc_id, text=text)
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(lambda batches: _pieces(batches, tokenizer_file, size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, seq long")


class Capacities:
    """Segment tree over the remaining capacities 0 .. size that says which have open bins."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        at += self.leaves
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity with an open bin that is not under ``least``."""
        at = least + self.leaves
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


@dataclass
class Plan:
    """Runs of equal pieces, longest first: from which rank on, into which first bin, how many a bin, and where in the bin."""

    base: dict[int, int]  # pieces before those of a length
    runs: np.ndarray  # rank, first bin, pieces a bin, offset, length
    bins: int


def best_fit(histogram: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Best-fit decreasing over ``{length: pieces}``; lengths lie between 1 and ``size``."""
    tree, open_bins = Capacities(size), {}
    base, runs, bins, rank = {}, [], 0, 0

    def put(left: int, first: int, count: int) -> None:
        if count and left:
            open_bins.setdefault(left, []).append((first, count))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        base[length], todo = rank, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, each = size, size // length
                first, count = bins, -(-todo // each)
                bins += count
            else:
                first, count = open_bins[left].pop()
                if not open_bins[left]:
                    tree.set(left, False)
                each = left // length
            placed = min(todo, count * each)
            full, rest = divmod(placed, each)
            runs.append((rank, first, each, size - left, length))
            put(left - each * length, first, full)
            put(left - rest * length, first + full, 1 if rest else 0)
            used = full + (1 if rest else 0)
            put(left, first + used, count - used)
            rank, todo = rank + placed, todo - placed
    return Plan(base, np.array(runs, np.int64).reshape(-1, 5), bins)


def _place(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    runs, base = plan.value.runs, plan.value.base
    for batch in batches:
        rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) + np.array([base[x] for x in batch.column(3).to_pylist()], np.int64)
        run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
        nth = rank - run[:, 0]
        arrays = [*[batch.column(i) for i in range(5)], pa.array(run[:, 1] + nth // run[:, 2]), pa.array(run[:, 3] + nth % run[:, 2] * run[:, 4])]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_file: str, size: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its ids and a closing id 1; one longer than ``size`` is cut into pieces of ``size``. Null and empty texts are the
    closing id alone. Repeated or null ids are packed as rows of their own, an empty table gives no sequences, other columns are ignored.
    The driver holds the number of pieces of each length (at most ``size`` numbers) and the plan made of them.
    """
    made = cut(pieces(docs, tokenizer_file, size, doc_id, text))
    counts = cut(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(best_fit(histogram, size))
    ranked = made.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("seq")).alias("rank"))
    return ranked.mapInArrow(lambda batches: _place(batches, plan), ", ".join(f"{c} {t}" for c, t in made.dtypes[:5]) + ", sequence_id long, offset long")
