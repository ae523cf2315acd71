"""Language-model scores by online logistic context mixing.

A document is coded as its lower-cased words with one space between them and one end byte. Every bit is predicted from several hashed
contexts at once: the last 2, 3, 4 and 6 bytes, and the word so far. A context's row holds, for the 15 nodes of a half byte, the log odds
of a one as counted over the training corpus; rows share slots where hashes meet. The log odds are mixed by weights that a gate picks (the bit's
place in its byte), and the weights are refined bit by bit: error times log odds is
added to those used. The summed code lengths give the total bits of a text, and bits per byte.

Counts and weights never come from the same document: training remainders 1 to 8 are counted, remainder 9 trains the weights online, each
block of text from the same start, and the tasks' weights are averaged by use. In scoring, each block of ``BLOCK`` bytes starts from the
trained weights and refines its own copy; contexts reach back over block ends. So thousands of blocks advance together, one bit a step.

The corpus is counted whole: words by a shuffle, contexts as sparse partial tables that are added up by slot range. The model is a table of
fixed size (about 2^19.9 rows of 16 bytes), whatever the corpus holds. Words that make up a share of at least 1 / ``HOT`` of all tokens
(so at most ``HOT`` words) are sent to the tasks; all others meet their counts by a join in which no key is frequent.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import by_size, plain, texts

ROW_BITS = (16, 17, 18, 18, 18)  # rows of the contexts of 2, 3, 4 and 6 bytes and of the word so far, as powers of two
N_CONTEXTS = len(ROW_BITS)
FIRST_ROW = np.concatenate(([0], np.cumsum([1 << b for b in ROW_BITS])))
RANGE = 1 << 16  # cells of a slot range, the unit in which partial tables are added up
STEP, ADD = 12.0, 0.15  # log odds are kept in steps of 1 / 12; a count of 0.15 stands before each bit
GATES = 8  # a set of weights for each bit of a byte
START_WEIGHT, RATE, REFINE = 0.3, 0.02, 0.005
BLOCK, PAD = 512, 6
SLICE = 2 << 20  # half an Arrow batch
POWERS = 1 << 18  # powers are kept for a multiple of this many bytes
CHUNK = 64
LEAST = 2.0**-15  # no bit is thought likelier than 1 - LEAST
HOT = 1 << 17
LONG_WORD = 64
END, SPACE = b"\n", 32
PATH = np.array([[4 | h >> 2, 8 | h >> 1] for h in range(16)]).T.copy()  # the last two nodes of a half byte, and its bits
BITS = np.array([[h >> 3 & 1, h >> 2 & 1, h >> 1 & 1, h & 1] for h in range(16)], np.float32).T.copy()


# ---------------------------------------------------------------- words

def token(word: bytes) -> bytes:
    """The key of a word; a long one is told by its digest, behind the end byte, which no word holds."""
    return word if len(word) <= LONG_WORD else END + hashlib.blake2b(word, digest_size=16).digest()


def split(data: bytes) -> list[bytes]:
    return data.lower().split()  # bytes: A-Z only, and the six white-space bytes


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 10; a null id has 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10, F.lit(1)).cast("int")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text"):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for data, r in zip(texts(batch, "text"), batch.column(1).to_pylist()):
            seen[r != 0].update(split(data))
            seen[r != 0][END] += 1
        keys = list(seen[1]) + [w for w in seen[0] if w not in seen[1]]
        trained = [seen[1].get(w, 0) for w in keys]
        total = [n + seen[0].get(w, 0) for w, n in zip(keys, trained)]
        yield pa.RecordBatch.from_arrays([pa.array([w if w == END else token(w) for w in keys], pa.binary()), pa.array(trained, pa.int64()), pa.array(total, pa.int64())], names=["token", "trained", "total"])


# ---------------------------------------------------------------- contexts

@dataclass
class Flat:
    """Documents of a slice end to end, each behind ``PAD`` spaces, with the start and the number of coded bytes of each."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(docs: list[list[bytes]]) -> Flat:
        bodies = [b" ".join(words) + END for words in docs]
        size = np.array([len(b) for b in bodies], np.int64)
        start = np.cumsum(size + PAD) - size
        gap = b" " * PAD
        return Flat(np.frombuffer(gap + gap.join(bodies), np.uint8), start, size)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^32."""
    odd = 0x01000193
    found = []
    for factor in (odd, pow(odd, -1, 1 << 32)):
        powers = np.full(n, factor, np.uint32)
        powers[0] = 1
        found.append(np.multiply.accumulate(powers, out=powers))
    return tuple(found)


def contexts(data: np.ndarray) -> Iterator[np.ndarray]:
    """For every position the mixed hash of each of its contexts; those of padding are of no use."""
    def mixed(h):
        h = h * np.uint32(0x9E3779B1)
        return (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)

    def back(j):
        return np.roll(data, j).astype(np.uint32)

    near = back(1)
    for j in (2, 3, 4):
        near |= back(j) << np.uint32(8 * (j - 1))
        yield mixed(near)
    near *= np.uint32(0x2545F491)
    near ^= (back(5) | back(6) << np.uint32(8)) * np.uint32(0x9E3779B1)
    yield mixed(near)
    up, down = (p[: len(data)] for p in _powers(max(1, -(-len(data) // POWERS)) * POWERS))
    sums = np.cumsum((data + np.uint32(1)) * up, dtype=np.uint32)  # of all bytes up to here, each times its power
    space = np.roll(np.maximum.accumulate(np.where(data == SPACE, np.arange(len(data), dtype=np.int32), 0)), 1)
    space[0] = 0
    yield mixed((np.roll(sums, 1) - sums[space]) * down[space])  # of the bytes since the last space, wherever that lies


def rows_at(hashed: np.ndarray, i: int, upper: np.ndarray | None = None) -> np.ndarray:
    """Rows of the i-th context for the upper half byte, or for the lower one behind a given upper half."""
    h = hashed if upper is None else (hashed + (upper.astype(np.uint32) + np.uint32(1)) * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return h >> np.uint32(32 - ROW_BITS[i])


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The half bytes that follow every row, counted over the task; rows of a slot range each."""
    count, one = [np.zeros(16 << b, np.uint32) for b in ROW_BITS], np.uint32(1)
    for batch in by_size(batches, "text", SLICE // 2):
        flat = Flat.of([split(data) for data in texts(batch, "text")])
        coded = np.ones(len(flat.data), bool)
        for j in range(PAD):
            coded[flat.start - 1 - j] = False
        data = flat.data[coded]
        upper, lower = data >> 4, data & 15
        for i, h in enumerate(contexts(flat.data)):
            h = h[coded]
            for row, half in ((rows_at(h, i), upper), (rows_at(h, i, upper), lower)):
                np.add.at(count[i], row << np.uint32(4) | half, one)
    salt = TaskContext.get().partitionId() >> 8
    for i, c in enumerate(count):
        for at in range(0, len(c), RANGE):
            if (part := c[at : at + RANGE]).any():
                yield _table_row(int(FIRST_ROW[i] * 16 + at) // RANGE, salt, part)


_PARTIAL = "part int, salt int, small binary, cells binary, counts binary"


def _table_row(part: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
    """Counts of a slot range: a byte each, and those from 255 on in full beside them; a range with few counts has these only."""
    few = np.count_nonzero(counts) < RANGE // 16
    large = np.flatnonzero(counts >= (1 if few else 255))
    payload = [np.minimum(counts, 0 if few else 255).astype(np.uint8)[: 0 if few else RANGE], large.astype("<u2"), counts[large].astype("<u8")]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in payload)], names=["part", "salt", "small", "cells", "counts"])


def _table_counts(small: bytes, cells: bytes, counts: bytes) -> np.ndarray:
    found = np.frombuffer(small, np.uint8).astype(np.uint64) if small else np.zeros(RANGE, np.uint64)
    found[np.frombuffer(cells, "<u2")] = np.frombuffer(counts, "<u8")
    return found


def _add_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tables added up; a task's rows come sorted by slot range and salt, so one range is held at a time."""
    own, total = None, np.zeros(RANGE, np.uint64)
    for batch in batches:
        for at in range(batch.num_rows):
            part, salt, *payload = (c[at].as_py() for c in batch.columns)
            if (part, salt) != own:
                if own is not None:
                    yield _table_row(*own, total)
                own, total = (part, salt), np.zeros(RANGE, np.uint64)
            total += _table_counts(*payload)
    if own is not None:
        yield _table_row(*own, total)


def odds(leaves: np.ndarray) -> np.ndarray:
    """Rows of 16 half-byte counts to rows of the log odds of the 15 nodes, in steps; the first byte of a row is not used."""
    out = np.zeros((len(leaves), 16), np.int8)
    for level in range(4):
        zero_one = leaves.reshape(len(leaves), 1 << level, 2, -1).sum(axis=3).astype(float)
        st = np.log(zero_one[:, :, 1] + ADD) - np.log(zero_one[:, :, 0] + ADD)
        out[:, 1 << level : 2 << level] = np.clip(np.rint(st * STEP), -127, 127)
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            part, _, *payload = (c[at].as_py() for c in batch.columns)
            rows = odds(_table_counts(*payload).reshape(-1, 16))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["part", "odds"])


def context_table(docs: DataFrame) -> np.ndarray:
    """The log odds of all rows: at most 2^19.9 x 16 bytes come to the driver."""
    partial = docs.select("text").mapInArrow(_count_contexts, _PARTIAL)
    added = partial.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_add_tables, _PARTIAL)
    whole = added.withColumn("salt", F.lit(0)).repartition("part").sortWithinPartitions("part")
    finished = whole.mapInArrow(lambda batches: _finish(_add_tables(batches)), "part int, odds binary")  # one pass: a second one in the stage would keep a second worker a core
    table = np.zeros(int(FIRST_ROW[-1]) * 16, np.int8)
    for r in finished.toLocalIterator(prefetchPartitions=True):
        table[r["part"] * RANGE : (r["part"] + 1) * RANGE] = np.frombuffer(r["odds"], np.int8)
    return table


# ---------------------------------------------------------------- mixing

@dataclass
class Mixed:
    cost: np.ndarray  # natural logarithm of the probability of each block, negated
    weights: np.ndarray  # gate, context: the blocks' last weights, summed by the bytes they coded
    n_bytes: float


def mix(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, weights: np.ndarray, rate: float) -> Mixed:
    """Codes all blocks (start, size) of the data side by side, a bit a step; every block refines its own copy of the weights."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    n, longest = len(start), int(size.max(initial=0))
    hashed, slots = list(contexts(data)), table.view(np.dtype("V16"))
    own = np.repeat(weights.astype(np.float32)[:, :, None], n, axis=2)  # gate, context, block
    cost, active = np.zeros(n), np.searchsorted(-size, -np.arange(longest), side="left")
    own, rate, least = own / np.float32(STEP), np.float32(rate / STEP**2), np.float32(LEAST)  # so that log odds go in as the steps they are kept in
    room, first_slot = np.empty(N_CONTEXTS * n, slots.dtype), np.arange(n) * 16
    for t in range(0, longest, CHUNK):
        m = int(active[t])
        at = np.minimum(start[:m, None] + np.arange(t, t + CHUNK), len(data) - 1)
        bytes_, hashes = data[at].T.copy(), [h[at].T.copy() for h in hashed]
        for u in range(min(CHUNK, longest - t)):
            m = int(active[t + u])
            upper, lower = bytes_[u, :m] >> 4, bytes_[u, :m] & 15
            picked = room[: N_CONTEXTS * m].reshape(N_CONTEXTS, m)
            nodes, grown = picked.view(np.int8), np.empty((N_CONTEXTS, m), np.float32)
            for half, above, gate in ((upper, None, 0), (lower, upper, 4)):
                for i in range(N_CONTEXTS):
                    np.take(slots[FIRST_ROW[i] : FIRST_ROW[i + 1]], rows_at(hashes[i][u, :m], i, above), out=picked[i], mode="clip")
                deep = nodes.take(PATH.take(half, axis=1) + first_slot[:m], axis=1, mode="clip").astype(np.float32)
                bits, likely = BITS.take(half, axis=1), np.ones(m, np.float32)
                xs = (nodes[:, 1::16].astype(np.float32), np.where(half > 7, nodes[:, 3::16], nodes[:, 2::16]).astype(np.float32), deep[:, 0], deep[:, 1])
                for k in range(4):
                    x, w = xs[k], own[gate + k, :, :m]
                    one = np.einsum("ij,ij->j", w, x)
                    np.exp(np.negative(one, out=one), out=one)
                    one += 1
                    miss = np.subtract(bits[k], np.reciprocal(one, out=one), out=one)
                    w += np.multiply(x, miss * rate, out=grown)
                    np.subtract(1, np.abs(miss, out=miss), out=miss)
                    likely *= np.minimum(np.maximum(miss, least, out=miss), 1 - least, out=miss)
                cost[:m] -= np.log(likely)
    back = np.empty(n)
    back[order] = cost
    return Mixed(back, (own * (size * STEP)).sum(axis=2), float(size.sum()))


def blocks(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and document of every block of at most ``BLOCK`` bytes."""
    per = -(-flat.size // BLOCK)
    doc = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return flat.start[doc] + nth * BLOCK, np.minimum(BLOCK, flat.size[doc] - nth * BLOCK), doc


@dataclass
class Model:
    """What scoring needs beside the log odds: weights, and how likely the frequent words and an unseen one are."""

    weights: np.ndarray
    tokens: int
    words: int
    hot: dict[bytes, int]

    def base(self, count):
        """log10 (c + 0.1) / (N + 0.1 (V + 1))."""
        return np.log10((np.asarray(count) + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


def first_weights() -> np.ndarray:
    return np.full((GATES, N_CONTEXTS), START_WEIGHT)


def _train(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    total, n_bytes = np.zeros(GATES * N_CONTEXTS), 0.0
    for batch in by_size(batches, "text", SLICE):
        flat = Flat.of([split(data) for data in texts(batch, "text")])
        got = mix(flat.data, *blocks(flat)[:2], table.value, first_weights(), RATE)
        total, n_bytes = total + got.weights.ravel(), n_bytes + got.n_bytes
    yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), n_bytes]], pa.list_(pa.float64()))], names=["total"])


def mixing_weights(docs: DataFrame, table) -> np.ndarray:
    """The blocks' refined weights, averaged by their bytes; without any text the first ones."""
    parts = docs.select("text").mapInArrow(lambda b: _train(b, table), "total array<double>").select(F.posexplode("total").alias("i", "v"))
    total = {r["i"]: r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}
    n_bytes = total.get(GATES * N_CONTEXTS, 0)
    return np.array([total[i] for i in range(GATES * N_CONTEXTS)]).reshape(GATES, N_CONTEXTS) / n_bytes if n_bytes else first_weights()


# ---------------------------------------------------------------- scoring

def _score(batches: Iterator[pa.RecordBatch], table, model) -> Iterator[pa.RecordBatch]:
    """A row per document: its code length, what its frequent words add to the base score, and its other words with their counts."""
    m: Model = model.value
    place, hot = {w: i for i, w in enumerate(m.hot)}, np.fromiter(m.hot.values(), np.int64, len(m.hot))
    log, end = m.base(hot), place.get(END, -1)
    key = TaskContext.get().partitionId() << 33
    for batch in by_size(batches, "text", SLICE):
        docs = [split(data) for data in texts(batch, "text")]
        flat = Flat.of(docs)
        start, size, doc = blocks(flat)
        bits = np.bincount(doc, mix(flat.data, start, size, table.value, m.weights, REFINE).cost, minlength=len(docs)) / np.log(2)
        sizes = np.array([len(words) for words in docs])
        ends = np.cumsum(sizes)
        at = np.fromiter(map(place.get, chain.from_iterable(docs), repeat(-1)), np.int64, sizes.sum())
        missed, other, far = (at < 0).tolist(), [], []  # far: frequent words that only their digest tells
        for words, upto, size in zip(docs, ends.tolist(), sizes.tolist()):
            other.append(left := Counter(compress(words, missed[upto - size : upto])))
            for w in [w for w in left if len(w) > LONG_WORD]:
                n, w = left.pop(w), token(w)
                if (hit := place.get(w, -1)) < 0:
                    left[w] = n
                else:
                    far.append((len(other) - 1, hit, n))
        if end < 0:
            for left in other:
                left[END] = 1
        found = at >= 0
        of, at = np.repeat(np.arange(len(docs)), sizes)[found], at[found]
        base = np.bincount(of, log[at], len(docs)) + (log[end] if end >= 0 else 0)
        known = np.bincount(of[hot[at] > 0], minlength=len(docs)) + (1 if end >= 0 and hot[end] else 0)
        for i, hit, n in far:
            base[i] += n * log[hit]
            known[i] += n if hot[hit] else 0
        rare, times = [list(left) for left in other], [list(left.values()) for left in other]
        n = len(docs)
        columns = [pa.array(np.arange(key, key + n)), batch.column(0), batch.column(1), pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                   pa.array(bits), pa.array(flat.size), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
        key += n
        yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "r", "n_tokens", "known", "base", "bits", "n_bytes", "rare", "times"])


def mixing_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte, one row per document.

    ``score`` is the mixed model's log10 probability of the text as coded here, ``base_score`` that of its tokens by smoothed counts. Texts
    that are null read as empty and have the end token only. Documents whose id leaves remainder 0 are held out; a null id is learned from.
    Repeated rows give repeated scores; ids may be of any type; an empty table gives an empty result, and where nothing is learned from
    every bit is as likely as not. Words that differ beyond ``LONG_WORD`` bytes are told apart by a digest of 128 bits.
    """
    sc = docs.sparkSession.sparkContext
    source = plain(docs, doc_id=doc_id, text=text).withColumn("r", remainder())
    kind = dict(source.dtypes)["doc_id"]
    seen = source.select("text", "r").mapInArrow(_count_words, "token binary, trained long, total long")
    counts = cut(seen.groupBy("token").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total")))
    n, words, everything = counts.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count_if(F.col("trained") > 0), F.coalesce(F.sum("total"), F.lit(0))).first()
    frequent = F.col("total") * HOT >= everything
    hot = {bytes(r["token"]): r["trained"] for r in counts.where(frequent).select("token", "trained").collect()}
    table = sc.broadcast(context_table(source.where((F.col("r") > 0) & (F.col("r") < 9))))
    weights = mixing_weights(source.where(F.col("r") == 9), table)
    model = sc.broadcast(Model(weights, n, words, hot))
    scored = cut(source.select("doc_id", "r", "text").mapInArrow(
        lambda b: _score(b, table, model), f"key long, doc_id {kind}, r int, n_tokens long, known long, base double, bits double, n_bytes long, rare array<binary>, times array<int>"))
    for sent in (table, model):  # the scores are written: no task needs these again
        sent.destroy()
    rare = scored.select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", F.col("w.rare").alias("token"), F.col("w.times").alias("times"))
    met = rare.join(counts.where(~frequent).select("token", "trained"), "token", "left")
    c = F.coalesce("trained", F.lit(0))
    added = met.groupBy("key").agg(F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(float(n + 0.1 * (words + 1))))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.drop("rare", "times").join(added, "key", "left")
    return out.select("doc_id", (F.col("r") == 0).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("bits") * -float(np.log10(2))).alias("score"), "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
