"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut at spaces that begin a piece, the parts by the tokenizer's pattern; each distinct part not yet known to the
worker is encoded once per batch.
Pieces are dealt into buckets of similar length, a bucket is a matrix of token ids padded on the right, and in each round every
row merges its leftmost pair of smallest rank. Pair ranks come from an open-addressing hash table in two numpy arrays. A merge
removes one column entry from each row that is still active, so the matrix is compacted by one boolean selection; rows
without a pair left are retired. Only the pairs beside a merge are looked up again.

A piece of more than LONG bytes (nearly all in one word) has a matrix of one row for itself. As one merge a round would take as many
rounds as bytes, a round merges all pairs of that row's smallest rank, from the left up to the first whose merge makes a pair of
a smaller rank, which would come next: just the merges that single rounds would make one after the other. Decoding concatenates
the bytes of each id.

Bounds: at most 2 * CACHE parts are remembered by a worker, and a matrix holds at most CELLS entries.

Edge cases: a null text counts as an empty one and has no ids; repeated rows are encoded each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

LONG = 256
CACHE = 120_000
CELLS = 1_000_000
NONE = np.int32(2**31 - 1)
#: A space that no other white space and no end follows begins a piece; texts with other spaces, or a NUL, take the slow split.
_ODD, _INNER, _SPACE = re.compile(r" (?=\s|\Z)|\0"), re.compile(r"(?<=[\s\S])(?= \S)"), re.compile(r"(?!\A)(?= )")
_BOUNDS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 40, 80, 160, LONG)


_WIDTH = [next(b for b in _BOUNDS if n <= b) for n in range(LONG + 1)]


class PairTable:
    """(left id, right id) -> id of their concatenation, by open addressing; NONE where the vocabulary has no such token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(10, int(len(left) * 3).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            first = todo[free]
            _, one = np.unique(at[first], return_index=True)
            placed = first[one]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            todo_taken = self.keys[at[todo]] != keys[todo]
            at[todo[todo_taken]] = (at[todo[todo_taken]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(left.shape)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(splits, np.int64).reshape(-1, 3).T)
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_lines(cls, lines: bytes, pattern: str) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}, pattern)

    def merge_matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        """The ids of each row as little-endian 32-bit integers."""
        n = len(rows)
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        ids = np.where(np.arange(width) < lengths[:, None], self.bytes_to_id[flat], -1).astype(np.int32)
        ranks = np.full((n, max(width - 1, 1)), NONE, np.int32)
        if width > 1:
            inside = ids[:, 1:] >= 0
            ranks[inside] = self.pairs.get(ids[:, :-1][inside], ids[:, 1:][inside])
        owner, out = np.arange(n), [b""] * n
        while len(owner):
            at = ranks.argmin(1)
            row = np.arange(len(owner))
            best = ranks[row, at]
            done = best == NONE
            for i in np.flatnonzero(done):
                out[owner[i]] = ids[i, : lengths[owner[i]]].tobytes()
            live = np.flatnonzero(~done)
            if not len(live):
                break
            ids, ranks, owner, at, best = ids[live], ranks[live], owner[live], at[live], best[live]
            row, w = np.arange(len(live)), ids.shape[1]
            ids[row, at] = best
            keep = np.ones((len(live), w), bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(live), w - 1)
            lengths[owner] -= 1
            if w == 2:
                ranks = np.full((len(live), 1), NONE, np.int32)
                continue
            keep = np.ones((len(live), w - 1), bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(live), w - 2)
            for side in (at - 1, at):  # the pairs that end and begin with the merged token
                ok = np.flatnonzero((side >= 0) & (side + 1 < lengths[owner]))
                ranks[ok, side[ok]] = self.pairs.get(ids[ok, side[ok]], ids[ok, side[ok] + 1])
                if side is at:
                    bad = np.flatnonzero((at + 1 >= lengths[owner]) & (at < w - 2))
                    ranks[bad, at[bad]] = NONE
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The ids of one long piece; each round makes as many merges of the smallest rank as single rounds would make in a row."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of pairs that overlap every second one, from the left
                first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            beside = np.zeros(len(at), bool)
            beside[1:] = at[1:] == at[:-1] + 2
            before, after = at > 0, at + 2 < len(ids)
            left, right = np.full(len(at), NONE, np.int32), np.full(len(at), NONE, np.int32)
            left[before] = self.pairs.get(np.where(beside, best, ids[at - 1])[before], np.full(int(before.sum()), best))
            right[after] = self.pairs.get(np.full(int(after.sum()), best), ids[np.minimum(at + 2, len(ids) - 1)][after])
            sooner = np.flatnonzero((left < best) | (right < best))
            if len(sooner):
                at = at[: sooner[0] + 1]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            keep = np.ones(len(ranks), bool)
            keep[at] = False
            ranks = ranks[keep]
            at = at - np.arange(len(at))
            for side in (at - 1, at):
                ok = side[(side >= 0) & (side + 1 < len(ids))]
                ranks[ok] = self.pairs.get(ids[ok], ids[ok + 1])
        return ids.astype("<i4").tobytes()

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces."""
        out, get = {}, self.ranks.get
        buckets: dict[int, list[tuple[str, bytes]]] = {b: [] for b in _BOUNDS}
        for piece in pieces:
            raw = piece.encode()
            if (whole := get(raw)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[piece] = self.merge_long(raw)
            else:
                buckets[_WIDTH[len(raw)]].append((piece, raw))
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                out.update(zip((p for p, _ in part), self.merge_matrix([r for _, r in part], width), strict=True))
        return out

    def chunks(self, text: str) -> list[str]:
        """Parts of text whose ends are ends of pieces too: a piece never runs on over a space that a non-space follows."""
        return _INNER.split(text) if _ODD.search(text) else _SPACE.split(text) if text[:1] == " " else text.replace(" ", "\0 ").split("\0")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        pieces = [self.pattern.findall(c) for c in new]
        ids = self.learn(list(set(chain.from_iterable(pieces)))).__getitem__
        learnt = {c: b"".join(map(ids, p)) for c, p in zip(new, pieces, strict=True)}
        if len(self.known) + len(learnt) <= 2 * CACHE:
            self.known.update(learnt)
            table = self.known.__getitem__
        else:
            table = ChainMap(learnt, self.known).__getitem__
        return [b"".join(map(table, parts)) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_WORKER: dict[tuple[int, str], Bpe] = {}


def encode(docs: DataFrame, ranks_file: str, pattern: str, carry: tuple[str, ...] = ("doc_id",), keep_ids: bool = False, block_chars: int = 1_000_000) -> DataFrame:
    """carry, n_tokens, ids_sha256, decoded_sha256 (and ids, an array, if keep_ids) for each row of docs (text and what is carried).

    The ranks (about a megabyte) are read on the driver and broadcast, so executors need no such file.
    """
    with open(ranks_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    name = hash(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name, pattern) not in _WORKER:
            _WORKER.clear()
            _WORKER[name, pattern] = Bpe.from_lines(shared.value, pattern)
        bpe = _WORKER[name, pattern]
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= block_chars):
                    chars += len(texts[stop])
                    stop += 1
                ids = bpe.encode_batch(texts[start:stop])
                columns = [
                    *batch.slice(start, stop - start).columns[1:],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = [*carry, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                start = stop
        bpe.known.clear()  # workers live on, their next task may be of another stage
        release()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("text").alias("__text"), *carry).mapInArrow(run, schema)
