"""SentencePiece encoding and decoding with a batched Viterbi search.

A text becomes words at places that no piece of the model spans, so words are segmented on their own. Words of equal length advance
together: the hashes of their substrings probe the sorted keys of the pieces, and at each end position the best piece that ends there is
kept for every word at once, with its start as backpointer. Characters that are no piece become byte pieces.

For a unigram model the best piece is that of the largest sum of scores. The pieces of a merge (BPE) model are ranks, not likelihoods: a
segmentation is the model's own exactly if each piece comes out of its own merges and no two neighbours would have merged across their
border. There the search allows a piece only after a last piece that it stays apart from, and exactly one is left at every position.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_size, plain, texts

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY = 10.0
MAX_CACHED, MAX_WORD = 300_000, 64
CELLS = 1 << 18  # characters that advance together
PAIR_SLOTS = 1 << 20  # pairs of pieces whose answer is kept
SLICE_BYTES = 4 << 20  # text that is encoded at once


class Model:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.vocab_size()
        name = [m.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(name[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        usable = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.unknown, self.unknown_score = m.unk_id(), min(m.get_score(i) for i in usable) - UNKNOWN_PENALTY
        self.raw = [bytes([int(name[i][1:-1], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else name[i].replace(SPACE, " ").encode() for i in range(n)]
        self.joins = {name[i][k : k + 2] for i in usable for k in range(len(name[i]) - 1)}
        if any(SPACE in name[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece of this model spans words")
        points = [np.array([ord(c) for c in name[i]], np.uint64) for i in usable]
        key = np.array([_hash(x[None, :])[0, -1] for x in points], np.uint64)
        order = np.argsort(key)
        self.keys, self.ids = key[order], np.array(usable, np.int64)[order]
        self.hash_of, self.size_of, self.score_of = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.full(n, -np.inf)
        self.hash_of[usable], self.size_of[usable] = key, [x.size for x in points]
        self.score_of[usable] = [m.get_score(i) for i in usable]
        self.sizes = sorted({x.size for x in points})
        self.power = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.sizes[-1] + 1)], np.uint64)
        self.merges = all(float(m.get_score(i)).is_integer() for i in usable)
        self.reachable = np.ones(n, bool)
        self.pairs, self.pairs_apart = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        if self.merges:
            self._spines({name[i]: i for i in usable}, n)

    def _spines(self, known: dict[str, int], n: int) -> None:
        """For every piece, the pieces that stand at its left and at its right end while its merges go on, and their scores."""
        left, right = {}, {}
        for text, i in known.items():
            parts, at_left, at_right = list(text), [text[0]], [text[-1]]
            while len(parts) > 1:
                able = [(self.score_of[known[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known]
                if not able:
                    break
                k = -max(able)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if parts[0] != at_left[-1]:
                    at_left.append(parts[0])
                if parts[-1] != at_right[-1]:
                    at_right.append(parts[-1])
            self.reachable[i] = len(parts) == 1 and all(p in known for p in (*at_left, *at_right))
            if self.reachable[i]:
                left[i], right[i] = [known[p] for p in at_left], [known[p] for p in at_right]
        deep = max(map(len, [*left.values(), *right.values()])) + 1
        self.left, self.right = (np.full((n, deep), -1, np.int32) for _ in range(2))
        for table, spines in ((self.left, left), (self.right, right)):
            for i, spine in spines.items():
                table[i, : len(spine)] = spine

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece of every hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], -1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``a`` and ``b`` beside each other stay as they are; pairs met lately are looked up."""
        pair = a * len(self.score_of) + b
        slot = (_mix(pair.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pairs[slot] != pair)
        out = self.pairs_apart[slot]
        if new.size:
            out[new] = self._stay_apart(a[new], b[new])
            # of pairs that share a slot only one stays, and its answer is written with it
            self.pairs[slot[new]] = pair[new]
            kept = new[self.pairs[slot[new]] == pair[new]]
            self.pairs_apart[slot[kept]] = out[kept]
        return out

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At no time while the pieces' own merges go on, best score first and leftmost first, does a merge across the border come first."""
        out, todo = np.ones(a.size, bool), np.arange(a.size)
        i, j = np.zeros(a.size, np.int64), np.zeros(a.size, np.int64)
        score = np.append(self.score_of, -np.inf)
        while todo.size:
            x, y = self.right[a[todo], i[todo]], self.left[b[todo], j[todo]]
            joined = self.hash_of[x] * self.power[np.minimum(self.size_of[y], len(self.power) - 1)] + self.hash_of[y]
            across = score[self.find(joined)]
            next_a, next_b = score[self.right[a[todo], i[todo] + 1]], score[self.left[b[todo], j[todo] + 1]]
            crossed = (across > -np.inf) & (across > next_a) & (across >= next_b)
            out[todo[crossed]] = False
            go = ~crossed & ((next_a > -np.inf) | (next_b > -np.inf))
            first = next_a >= next_b
            i[todo[go & first]] += 1
            j[todo[go & ~first]] += 1
            todo = todo[go]
        return out


@lru_cache(maxsize=2)
def load(model_file: str) -> Model:
    return Model(model_file)


def _mix(points: np.ndarray) -> np.ndarray:
    x = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _hash(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row, the empty one first."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    mixed = _mix(points)
    for j in range(points.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + mixed[:, j]
    return out


def viterbi(model: Model, words: list[str]) -> list[list[int]]:
    """Piece ids of the model's segmentation of words of one length; of equal sums of scores, that with the shortest last piece."""
    n, size = len(words), len(words[0])
    prefix = _hash(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).astype(np.uint64))
    sizes = [k for k in model.sizes if k <= size]
    ends = {k: model.find(prefix[:, k:] - prefix[:, : size + 1 - k] * model.power[k]) for k in sizes}
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0.0
    back, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int64)
    for end in range(1, size + 1):
        best[:, end], back[:, end] = best[:, end - 1] + model.unknown_score, 1
        for k in sizes:
            if k > end:
                break
            found = ends[k][:, end - k]
            able = (found >= 0) & model.reachable[found]
            if model.merges and end > k and able.any():
                row = np.flatnonzero(able & (piece[:, end - k] >= 0))
                able[row] = model.apart(piece[row, end - k], found[row])
            score = np.where(able, best[:, end - k] + (0.0 if model.merges else model.score_of[found]), -np.inf)
            better = score > best[:, end]
            best[better, end], back[better, end], piece[better, end] = score[better], k, found[better]
    out = []
    for row in range(n):
        path, end = [], size
        while end:
            if piece[row, end] >= 0:
                path.append(int(piece[row, end]))
            else:
                path += [model.bytes_at.get(b, model.unknown) for b in reversed(words[row][end - 1].encode())]
            end -= int(back[row, end])
        out.append(path[::-1])
    return out


class Encoder:
    def __init__(self, model_file: str) -> None:
        self.model = load(model_file)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _cut(self, word: str) -> list[str]:
        """Parts of a word between neighbours that stand together in no piece."""
        cuts = [0, *[k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.model.joins], len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        parts = {w: self._cut(w) for w in words}
        lengths: dict[int, list[str]] = {}
        known = self.parts
        for part in dict.fromkeys(p for cut in parts.values() for p in cut):
            if part not in known:
                lengths.setdefault(len(part), []).append(part)
        now: dict[str, bytes] = {}
        for size, group in lengths.items():
            step = max(1, CELLS // size)
            for at in range(0, len(group), step):
                now.update((p, np.array(ids, "<i4").tobytes()) for p, ids in zip(group[at : at + step], viterbi(self.model, group[at : at + step])))
        out = {w: b"".join([now[p] if p in now else known[p] for p in cut]) for w, cut in parts.items()}
        if len(known) > MAX_CACHED:
            known.clear()
        known.update((p, ids) for p, ids in now.items() if len(p) <= MAX_WORD)
        return out

    def __call__(self, batch: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers; a leading space is added, an empty text has no ids."""
        split = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in batch]
        if len(self.known) > MAX_CACHED:
            self.known.clear()
        now = self._encode([w for w in dict.fromkeys(w for found in split for w in found) if w not in self.known])
        self.known.update((w, ids) for w, ids in now.items() if len(w) <= MAX_WORD)
        return [b"".join([self.known[w] if len(w) <= MAX_WORD else now[w] for w in found]) for found in split]


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    """One encoder per worker process: words met in one task are known in the next."""
    return Encoder(model_file)


def _coded(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[bytes]]]:
    """Slices of the batches, their texts and the ids of each text."""
    encode = encoder(model_file)
    for batch in by_size(batches, "text", SLICE_BYTES):
        told = [data.decode(errors="replace") for data in texts(batch, "text")]
        yield batch, told, encode(told)


def _encode(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    for batch, _, coded in _coded(batches, model_file):
        offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "text", "ids"])


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, ids) of every document; null and empty texts have no ids. Further columns are ignored, repeated rows and null ids
    are encoded like any other, an empty table gives an empty result."""
    source = plain(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(lambda batches: _encode(batches, model_file), f"doc_id {dict(source.dtypes)['doc_id']}, text string, ids array<int>")


def _decoded(raw: list[bytes], ids: list[int]) -> str:
    """The text that ids stand for, without the space that encoding put before it."""
    return b"".join([raw[i] for i in ids])[1:].decode(errors="replace")


def _decode(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    raw = load(model_file).raw
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        out = [_decoded(raw, ids or []) for ids in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """``coded`` (with a column ``ids``) and the text it stands for in ``decoded``; null and empty ids decode to the empty text. A text
    that itself holds the model's word mark comes back with spaces there."""
    schema = ", ".join(f"`{c}` {t}" for c, t in coded.dtypes)
    return coded.mapInArrow(lambda batches: _decode(batches, model_file), f"{schema}, decoded string")


def _digest(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    raw = load(model_file).raw
    for batch, told, coded in _coded(batches, model_file):
        same = [_decoded(raw, np.frombuffer(c, "<i4").tolist()) == t.replace(SPACE, " ") for t, c in zip(told, coded)]
        columns = [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])


def piece_digest(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and round_trip: whether decoding the ids gives the text back, the
    model's word mark read as a space. Texts are encoded and decoded in one pass, so ids never travel; edge cases as in ``encode``."""
    source = plain(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(lambda batches: _digest(batches, model_file), f"doc_id {dict(source.dtypes)['doc_id']}, n_ids long, ids_crc32 long, round_trip boolean")
