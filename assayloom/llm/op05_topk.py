"""Exact top-k search by inner product over a pivot-distance index.

Components are taken as floor(256 x). With M the greatest norm, a vector x is placed at (x, sqrt(M^2 - |x|^2)) and a query q at
(q, 0): the inner product is then (|q|^2 + M^2 - D^2) / 2 for their distance D, so the largest products are the nearest points.
Each vector is keyed by its nearest pivot and its distance from it, sorted, and packed into blocks of at most ROWS vectors: parts
of annuli around a pivot. The triangle inequality bounds D from below by how far a query's own distance from the pivot lies
outside a block's annulus.

Queries are packed in blocks too. First each meets the annulus nearest to it, which sets its k-th score so far; then the annuli
grow outwards: only those whose bound can still reach that score are searched, and within them only the rows in reach. Scores are
exact integers, and a bound that equals a score is searched, so ties go to the smaller id.

Pivots are a bounded sample, PIVOTS rows of the smallest hash of their id for each vector length; every vector is indexed.

Edge cases: vectors that are null or empty, hold a null or non-finite component, have no id, or a squared norm of 2**62 or more
(no long score) take no part; vectors of different length are not compared; rows of one id are no candidates for each
other, and each of them is a candidate for the rest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

PIVOTS = 64
ROWS = 2048
QUERIES = 512
SCALE = 256


def quantise(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, norm, v (little-endian 32-bit integers) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(lengths)
            whole = np.floor(values * SCALE)
            fit = np.abs(whole) < 2**31  # false for NaN (nulls too) and infinities
            ids, dims, norms, packed = [], [], [], []
            for vec_id, lo, hi in zip(batch.column(0).to_pylist(), ends - lengths, ends, strict=True):
                if vec_id is None or hi == lo or not fit[lo:hi].all():
                    continue
                norm = float((whole[lo:hi] ** 2).sum())
                if norm < 2**62:
                    x = whole[lo:hi].astype(np.int64)
                    ids.append(vec_id)
                    dims.append(int(hi - lo))
                    norms.append(int((x * x).sum()))
                    packed.append(x.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "dim", "norm", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, norm long, v binary")


class Space:
    """The pivots of one vector length, and the greatest squared norm."""

    def __init__(self, pivots: np.ndarray, top: int) -> None:
        self.pivots, self.top = pivots, top
        self.rest = np.sqrt(np.maximum(top - (pivots**2).sum(1), 0))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2.0 * self.top - 2 * x @ self.pivots.T - 2 * np.outer(rest, self.rest), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.top - 2 * q @ self.pivots.T, 0))

    def reach(self, norms: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance up to which a product of least or more is possible, with room for rounding."""
        room = 1.0 + 1e-9 * (norms + self.top)
        return np.sqrt(np.maximum(norms + self.top - 2.0 * least, 0) + room) * (1 + 1e-9)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _keyed(points: DataFrame, spaces, queries: bool) -> DataFrame:
    """points with cell (nearest pivot) and dist from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                space, x = spaces.value[dim], _matrix(part.column("v"), dim).astype(np.float64)
                d = space.of_queries(x) if queries else space.of_vectors(x)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*part.schema.names, "cell", "dist"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, cell int, dist double")


def _packed(points: DataFrame, rows: int) -> DataFrame:
    """block, dim, cell, lo, hi, ids, dists, vs (and least): at most rows sorted points of one length and cell in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        block = TaskContext.get().partitionId() << 32

        def pack() -> pa.RecordBatch:
            nonlocal block
            block += 1
            ids, dists, vs, least = zip(*(x[2:] for x in held), strict=True)
            values = [block, held[0][0], held[0][1], min(dists), max(dists), np.array(ids, "<i8").tobytes(), np.array(dists).tobytes(), b"".join(vs), np.array(least, "<i8").tobytes()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "dim", "cell", "lo", "hi", "ids", "dists", "vs", "least"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("dim", "cell", "vec_id", "dist", "v", "least")]
            for row in zip(*columns, strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == rows):
                    yield pack()
                    held = []
                held.append(row)
        if held:
            yield pack()

    dealt = points.repartitionByRange("dim", "cell", "dist", "vec_id").sortWithinPartitions("dim", "cell", "dist", "vec_id")
    return dealt.select("dim", "cell", "vec_id", "dist", "v", "least").mapInArrow(run, "block long, dim int, cell int, lo double, hi double, ids binary, dists binary, vs binary, least binary")


_NONE = -(2**63)


def _search(pairs: DataFrame, asked: DataFrame, index: DataFrame, spaces, k: int) -> DataFrame:
    """query_id, vec_id, score, block, place: the k best of each query in each of the pairs (block of queries, block of the index)."""
    left = asked.select(F.col("block").alias("asked"), "dim", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), "least")
    right = index.select("block", "cell", "ids", "dists", "vs")
    joined = pairs.join(left, "asked").join(right, "block").select("block", "dim", "cell", "q_ids", "q_vs", "least", "ids", "dists", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                space, dim = spaces.value[r["dim"]], r["dim"]
                q, x = (np.frombuffer(r[c], "<i4").reshape(-1, dim).astype(np.int64 if space.top >= 2**53 else np.float64) for c in ("q_vs", "vs"))
                q_ids, ids, least = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "ids", "least"))
                dists = np.frombuffer(r["dists"])
                mine = space.of_queries(q.astype(np.float64))[:, r["cell"]]
                known = least != _NONE
                reach = np.where(known, space.reach((q.astype(np.float64) ** 2).sum(1), np.where(known, least, 0).astype(np.float64)), np.inf)
                first, last = np.searchsorted(dists, mine - reach), np.searchsorted(dists, mine + reach, "right")
                use = np.flatnonzero(first < last)
                if not len(use):
                    continue
                lo, hi = int(first[use].min()), int(last[use].max())
                scores = (q[use] @ x[lo:hi].T).astype(np.int64)
                near = ids[lo:hi]
                query, found, score, place = [], [], [], []
                for row, own in zip(scores, q_ids[use], strict=True):
                    at = np.flatnonzero(near != own)
                    if len(at) > k:
                        cut = np.partition(row[at], len(at) - k)[len(at) - k]
                        at = at[row[at] >= cut]
                        at = at[np.lexsort((near[at], -row[at]))][:k]
                    query.append(np.full(len(at), own))
                    found.append(near[at])
                    score.append(row[at])
                    place.append(lo + at)
                columns = [np.concatenate(c) for c in (query, found, score)]
                columns += [np.full(len(columns[0]), r["block"]), np.concatenate(place)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "block", "place"])

    return joined.mapInArrow(run, "query_id long, vec_id long, score long, block long, place long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "block", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k best among the others."""
    points = materialise(quantise(vectors), "points")
    tops = {r.dim: r.top for r in points.groupBy("dim").agg(F.max("norm").alias("top")).collect()}
    chosen = points.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v"))).where(F.col("n") <= PIVOTS)
    drawn: dict[int, list[bytes]] = {}
    for r in chosen.select("dim", "v").collect():
        drawn.setdefault(r.dim, []).append(bytes(r.v))
    spaces = vectors.sparkSession.sparkContext.broadcast(
        {d: Space(np.unique(np.frombuffer(b"".join(v), "<i4").reshape(-1, d), axis=0).astype(np.float64), tops[d]) for d, v in drawn.items()}
    )
    index = materialise(_packed(_keyed(points.withColumn("least", F.lit(_NONE)), spaces, False), ROWS), "index")
    asking = points.where(F.col("vec_id") % every == 0).distinct()
    asked = materialise(_packed(_keyed(asking.withColumn("least", F.lit(_NONE)), spaces, True), QUERIES), "asked")
    outline = index.select("block", "dim", "cell", "lo", "hi")
    reached = materialise(_pairs(asked, outline, spaces, nearest=True), "nearest")
    first = materialise(_best(_search(reached, asked, index, spaces, k), k), "first")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    again = asking.join(kth, "vec_id", "left").withColumn("least", F.coalesce("kth", F.lit(_NONE))).drop("kth")
    asked = materialise(_packed(_keyed(again, spaces, True), QUERIES), "asked")
    second = _search(materialise(_pairs(asked, outline, spaces, nearest=False), "within"), asked, index, spaces, k)
    both = first.select(second.columns).unionByName(second).distinct()  # a row found twice has one place
    return _best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pairs(asked: DataFrame, outline: DataFrame, spaces, nearest: bool) -> DataFrame:
    """asked, block: the blocks of the index nearest to some query of a block, or those that some query may still gain from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["block", "dim", "vs", "least"]).to_pylist():
                space = spaces.value[r["dim"]]
                q = np.frombuffer(r["vs"], "<i4").reshape(-1, r["dim"]).astype(np.float64)
                d, least = space.of_queries(q), np.frombuffer(r["least"], "<i8")
                known = least != _NONE
                reach = np.where(known, space.reach((q**2).sum(1), np.where(known, least, 0).astype(np.float64)), np.inf)
                n = d.shape[1]
                if nearest:
                    rows = np.unique(np.stack([d.argmin(1), d.min(1)], 1), axis=0)
                    cell, low, high = rows[:, 0], rows[:, 1], rows[:, 1]
                else:
                    cell, low, high = np.arange(n), (d - reach[:, None]).min(0), (d + reach[:, None]).max(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cell), r["block"])), pa.array(np.full(len(cell), r["dim"]).astype(np.int32)),
                    pa.array(np.asarray(cell).astype(np.int32)), pa.array(low), pa.array(high),
                ], ["asked", "dim", "cell", "low", "high"])

    wanted = asked.select("block", "dim", "vs", "least").mapInArrow(run, "asked long, dim int, cell int, low double, high double")
    met = wanted.join(outline, ["dim", "cell"])
    if not nearest:
        return met.where((F.col("lo") <= F.col("high")) & (F.col("hi") >= F.col("low"))).select("asked", "block").distinct()
    gap = F.greatest(F.col("lo") - F.col("low"), F.col("low") - F.col("hi"), F.lit(0.0))
    return met.groupBy("asked", "dim", "cell", "low").agg(F.min_by("block", F.struct(gap, "block")).alias("block")).select("asked", "block").distinct()
