"""Near-duplicate documents by 64-bit similarity fingerprints and Golay-code fuzzy hashing.

The fingerprint is cut into three segments of at most 23 bits. The binary Golay code of length 23 puts every 23-bit word within three
bits of exactly one codeword, so the codewords that a word and its one-bit neighbours decode to (one or six of them) are shared by any
two words at most two bits apart. Of four differing bits over three segments at most one segment can hold three or more, hence two
segments hold two or fewer each: linked fingerprints share a key made of the codeword indices of two segments. Fingerprints under a key
are verified by their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import by_size, plain, texts, words
from .components import components

SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, number of bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay generator polynomial
BLOCK = 4096  # fingerprints of one key compared in one piece; larger keys are split into pairs of such blocks
SMALL = 24


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text"):
        out = np.zeros(batch.num_rows, np.uint64)
        for row, data in enumerate(texts(batch, "text")):
            found = words(data.lower())
            if not found:
                continue
            joined = b" ".join(found)
            ends = np.cumsum([len(w) + 1 for w in found]) - 1
            n = max(1, len(found) - width + 1)
            starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
            stops = ends[-n:].tolist()
            hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
            ones = np.zeros(64, np.int64)
            for at in range(0, n, 32768):
                part = hashed[at : at + 32768]
                ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[row] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): one 64-bit fingerprint a row over the shingles of ``width`` words, signed as Spark's long."""
    source = plain(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(lambda batches: _fingerprints(batches, width), f"doc_id {dict(source.dtypes)['doc_id']}, fp long")


class Golay:
    """Syndrome decoding of 23-bit words, vectorised."""

    def __init__(self) -> None:
        self.unit = np.array([self._remainder(1 << b) for b in range(23)], np.int64)
        self.low, self.high = self._table(self.unit[:12]), self._table(self.unit[12:])
        self.error = np.zeros(2048, np.int64)
        for weight in range(1, 4):
            for bits in combinations(range(23), weight):
                self.error[np.bitwise_xor.reduce(self.unit[list(bits)])] = sum(1 << b for b in bits)

    @staticmethod
    def _remainder(word: int) -> int:
        for b in range(22, 10, -1):
            if word >> b & 1:
                word ^= GENERATOR << (b - 11)
        return word

    @staticmethod
    def _table(units: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << len(units), np.int64)
        for b, unit in enumerate(units):
            table[1 << b : 2 << b] = table[: 1 << b] ^ unit
        return table

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        return self.low[word & 4095] ^ self.high[word >> 12]

    def keys(self, word: np.ndarray) -> list[np.ndarray]:
        """Per word the sorted distinct indices (12 bits) of the codewords next to it or to a one-bit neighbour."""
        syndrome = self.syndrome(word)
        near = [(word ^ self.error[syndrome]) >> 11]
        near += [(word ^ (1 << b) ^ self.error[syndrome ^ unit]) >> 11 for b, unit in enumerate(self.unit)]
        table = np.sort(np.stack(near, axis=1), axis=1)
        fresh = np.ones(table.shape, bool)
        fresh[:, 1:] = table[:, 1:] != table[:, :-1]
        table[~fresh] = 4096
        table.sort(axis=1)
        return table[:, :6]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            signed = whole.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).astype(np.int64)
            fp = signed.view(np.uint64)
            near = [golay.keys(((fp >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64)) for first, n in SEGMENTS]
            for i, j in ((0, 1), (0, 2), (1, 2)):
                pair = ((i + j) << 24) | (near[i][:, :, None] << 12) | near[j][:, None, :]
                used = (near[i][:, :, None] < 4096) & (near[j][:, None, :] < 4096)
                who = np.nonzero(used)[0]
                yield pa.RecordBatch.from_arrays([pa.array(pair[used].astype(np.int32)), pa.array(signed[who])], names=["key", "fp"])


def _reach(block: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one block: each fingerprint is a centre once, against those not reached yet."""
    left, out_a, out_b = block, [], []
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            centre = todo.pop()
            hit = np.bitwise_count(left ^ centre) <= bits
            if hit.any():
                found, left = left[hit], left[~hit]
                todo += list(found)
                out_a.append(np.full(found.size, centre, np.uint64))
                out_b.append(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _links(a: np.ndarray, b: np.ndarray, block: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    arrays = [a.view(np.int64), b.view(np.int64), block.astype(np.int32), key.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "b", "block", "key"])


def _verify(batches: Iterator[pa.RecordBatch], bits: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in: verified links (block null reads as -1), and the members of keys larger than ``size``, by blocks."""
    held_key, held_fp, blocks = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    seen: set[tuple[int, int]] = set()

    def fresh(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if len(seen) > 1_000_000:
            seen.clear()
        rows = []
        for x, y in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()):
            if (x, y) not in seen:
                seen.add((x, y))
                rows.append((x, y))
        pairs = np.array(rows, np.uint64).reshape(-1, 2)
        return _links(pairs[:, 0].copy(), pairs[:, 1].copy(), np.full(len(rows), -1), np.full(len(rows), -1))

    def whole_keys(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, key.size))
        small = np.repeat(sizes <= SMALL, sizes)
        k, f = key[small], fp[small]
        for shift in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=1)))):
            hit = (k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= bits)
            if hit.any():
                yield fresh(f[:-shift][hit], f[shift:][hit])
        for start, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            yield fresh(*_reach(fp[start : start + n], bits))

    for batch in batches:
        held_key = np.concatenate((held_key, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        held_fp = np.concatenate((held_fp, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        while held_key.size:
            last = int(np.searchsorted(held_key, held_key[-1]))
            first_end = int(np.searchsorted(held_key, held_key[0], side="right"))
            if blocks and first_end < held_key.size:  # a large key ends: its rest is its last block
                yield _links(held_fp[:first_end], held_fp[:first_end], np.full(first_end, blocks), held_key[:first_end])
                held_key, held_fp, blocks = held_key[first_end:], held_fp[first_end:], 0
            elif last:
                yield from whole_keys(held_key[:last], held_fp[:last])
                held_key, held_fp = held_key[last:], held_fp[last:]
            elif held_key.size > size:
                yield _links(held_fp[:size], held_fp[:size], np.full(size, blocks), held_key[:size])
                held_key, held_fp, blocks = held_key[size:], held_fp[size:], blocks + 1
            else:
                break
    if blocks:
        yield _links(held_fp, held_fp, np.full(held_fp.size, blocks), held_key)
    elif held_key.size:
        yield from whole_keys(held_key, held_fp)


def _verify_blocks(pdf, bits: int):
    import pandas as pd

    a, b = _reach(np.unique(pdf["fp"].to_numpy().astype(np.int64)).view(np.uint64), bits)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(prints: DataFrame, bits: int = MAX_BITS, size: int = BLOCK) -> DataFrame:
    """(a, b): links that span every group of the distinct fingerprints ``fp`` within ``bits`` (at most 4) bits of each other.

    Keys with more than ``size`` fingerprints are not held by one task: their blocks meet pair by pair, so each task sees two blocks.
    """
    if bits > 4:
        raise ValueError("the keys cover at most four differing bits")
    keyed = prints.select("fp").distinct().mapInArrow(_keys, "key int, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(lambda batches: _verify(batches, bits, size), "a long, b long, block int, key int"))
    plain_links = found.where("block < 0").select("a", "b")
    members = found.where("block >= 0").select("key", "block", F.col("a").alias("fp"))
    last = members.groupBy("key").agg(F.max("block").alias("last"))
    spread = members.join(last, "key").select("fp", "key", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    meet = spread.select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    crossed = meet.groupBy("key", "i", "j").applyInPandas(lambda pdf: _verify_blocks(pdf, bits), "a long, b long")
    return plain_links.unionByName(crossed).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, bits: int = MAX_BITS, size: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Words are runs without white space, A-Z read as a-z. A null or blank text has fingerprint zero and is linked like any other. Equal
    fingerprints always link. Documents without an id keep their row with a null component. Repeated ids give repeated rows. An empty
    table gives an empty result; further columns are ignored.
    """
    prints = cut(fingerprints(docs, doc_id, text, width))
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    member = components(links(firsts, bits, size))
    roots = firsts.join(member, firsts.fp == member.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group, with its own columns; of rows that share an id one stays. Rows without an id stay."""
    firsts = simhash_groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    kept = docs.join(firsts, docs["doc_id"] == firsts["_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
