"""Exact Jaccard join of word shingle sets, by token-combination prefixes.

Nodes are distinct shingle sets (a 128-bit digest), so exact copies never meet as pairs. With overlap threshold a = ceil(0.8 n),
a set of n shingles can miss at most n - a of them in a partner. Shingles are ordered by class, then by hash:

* class 0, found in one set only: they count towards the prefix, but nothing is indexed for them;
* class 1, rare: indexed one by one;
* class 2, frequent (in at least `frequent` sets): indexed as combinations of two from the same subclass. The prefix is extended
  until its coverage, one for each shingle of classes 0 and 1 and one less than their number for those of a subclass, exceeds
  n - a. Each missing shingle lowers the coverage by one at most, so linked sets still share a combination. The number of
  subclasses follows the size of the set, so that the combinations stay in proportion to it; a set is indexed for its own
  size class and, if a larger partner could fall into the next, for that one too.

Classes come from counts over all documents, kept as bit maps of fixed size; a false bit moves a shingle to a later class in
every set alike and costs time, never a link.

Key groups are not expanded into pairs. Of each key the pivot is the set with the smallest share of unshared shingles, of a group
of near copies most likely the text that they were made from. Each set is verified against the pivot with which it shares the most keys,
its family's, which links near copies as stars. A further link between sets x and y of one key then needs one of these:

* they are of different families: verified if the sizes and the numbers of repeated shingles allow a link;
* they are of one family with pivot p, one of them not linked with p, and share a shingle outside p: found by those shingles;
* they share none outside p. Then their overlap is at most that of either with p, so y must be smaller than p by enough: found
  by the bound 180 min(|x & p|, |y & p|) >= 80 (|x| + |y|).

Pairs that are in one component already are left out. So no link that joins two components is missed.

Only one document of each set is counted and indexed: a bit map of the representatives' ids, of fixed size, passes each of them, and
of the other copies a few by chance, which are merged later.

Edge cases: a null text or one without words has an empty set, links with nothing and is its own component; a text of 1 to 4
words is one shingle; equal sets are one component whatever the rows; repeated rows get the same component; rows with a null
doc_id keep a null component unless a copy has an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import materialise, slices
from .shingles import mix, shingle_sets

#: Candidates for the least number of sets in which a frequent shingle is found; the smallest that keeps MOST_FREQUENT is used.
FREQUENT = (64, 512, 4096, 32768)
MOST_FREQUENT = 1 << 21
REPEATED_BITS, FREQUENT_BITS = 28, 24
BUCKET = 1 << 21
BLOCK_CHARS = 1_000_000
FLUSH = 1_500_000


def _blocks(batches: Iterator[pa.RecordBatch], chosen: bytes | None = None) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """doc_ids and shingle sets of a bounded number of characters at a time; with a bit map, of the rows whose third column it holds."""
    for batch in batches:
        if chosen is not None:
            at = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - int(math.log2(len(chosen) * 8)))
            bits = np.frombuffer(chosen, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
            batch = batch.filter(pa.array((bits & 1).astype(bool)))
        for part in slices(iter([batch])):
            texts, start = [t or "" for t in part.column(1).to_pylist()], 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= BLOCK_CHARS):
                    chars, stop = chars + len(texts[stop]), stop + 1
                yield part.column(0).slice(start, stop - start), shingle_sets(texts[start:stop])
                start = stop


def representatives(members: DataFrame) -> bytes:
    """A bit map over the hash of doc_id in which one document of each set is set."""
    chosen = members.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    bits = max(14, min(REPEATED_BITS, math.ceil(math.log2(max(members.count(), 1))) + 5))
    low = max(3, bits - 10)

    def segment(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << low, np.uint8)
        out[rows["slot"].to_numpy() & ((1 << low) - 1)] = 1
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "map": [np.packbits(out, bitorder="little").tobytes()]})

    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    parts = chosen.select(slot.alias("slot"), F.shiftright(slot, low).alias("part")).distinct()
    whole = bytearray(1 << (bits - 3))
    for r in parts.groupBy("part").applyInPandas(segment, "part long, map binary").collect():
        whole[r.part * len(r.map) : (r.part + 1) * len(r.map)] = r.map
    return bytes(whole)


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def set_members(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sid (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "sid"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, sid binary")


class Classes:
    """Which shingles are found in several sets, and which in many."""

    def __init__(self, repeated: bytes, frequent: bytes) -> None:
        self.maps = [(np.frombuffer(m, np.uint8), np.uint64(64 - int(math.log2(len(m) * 8)))) for m in (repeated, frequent)]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        bits = []
        for bitmap, shift in self.maps:
            at = (hashes >> shift).astype(np.int64)
            bits.append((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        return bits[0] + (bits[0] & bits[1])


def count_classes(docs: DataFrame, shingles: int, chosen) -> Classes:
    """Counts over all sets, dealt by the leading bits of the hash. chosen: the broadcast bit map of representatives."""
    bucket_bits = max(4, math.ceil(math.log2(max(shingles, 1) / BUCKET + 1)))
    wide = max(bucket_bits + 3, min(REPEATED_BITS, math.ceil(math.log2(max(shingles, 1))) + 3))
    narrow = max(bucket_bits + 3, min(FREQUENT_BITS, wide))

    def packed(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(hashes), return_counts=True)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        bucket = (found >> np.uint64(64 - bucket_bits)).astype(np.int64)
        low = ((found << np.uint64(bucket_bits)) >> np.uint64(32)).astype(np.uint32)
        ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[starts], pa.int64()),
            pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        ], ["bucket", "low", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0
        for _, sets in _blocks(batches, chosen.value):
            for s in sets:
                key = _digest(s)
                if key is None or key in seen:
                    continue
                seen.add(key)
                held.append(s)
                size += len(s)
            if size >= FLUSH:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def bit_maps(rows: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(rows["low"]), np.uint32)
        counts = np.frombuffer(b"".join(rows["counts"]), np.uint16)
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        starts = np.flatnonzero(np.diff(low, prepend=np.uint32(0)) != 0)
        starts = np.unique(np.concatenate([[0], starts]))
        low, sums = low[starts], np.add.reduceat(counts.astype(np.int64), starts)

        def bitmap(which: np.ndarray, bits: int) -> bytes:
            out = np.zeros(1 << (bits - bucket_bits), np.uint8)
            out[low[which] >> np.uint32(32 - (bits - bucket_bits))] = 1
            return np.packbits(out, bitorder="little").tobytes()

        return pd.DataFrame({
            "bucket": [int(rows["bucket"].iloc[0])], "repeated": [bitmap(sums > 1, wide)],
            "kinds": [[int((sums >= d).sum()) for d in FREQUENT]], "frequent": [[bitmap(sums >= d, narrow) for d in FREQUENT]],
        })

    chunks = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(gather, "bucket long, low binary, counts binary")
    found = chunks.groupBy("bucket").applyInPandas(bit_maps, "bucket long, repeated binary, kinds array<long>, frequent array<binary>").collect()
    level = next((i for i in range(len(FREQUENT)) if sum(r.kinds[i] for r in found) <= MOST_FREQUENT), len(FREQUENT) - 1)
    repeated, frequent = bytearray(1 << (wide - 3)), bytearray(1 << (narrow - 3))
    for r in found:
        for whole, piece in ((repeated, r.repeated), (frequent, r.frequent[level])):
            whole[r.bucket * len(piece) : (r.bucket + 1) * len(piece)] = piece
    return Classes(bytes(repeated), bytes(frequent))


def index_keys(hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The keys of a set: single rare shingles and combinations of two frequent ones, from its extended prefix."""
    n = len(hashes)
    coverage = n - (4 * n + 4) // 5 + 1 - int((kinds == 0).sum())
    if n < 4 or coverage <= 0:  # a set of fewer shingles is linked with equal ones only
        return np.empty(0, np.uint64)
    rare = hashes[kinds == 1][:coverage]
    coverage -= len(rare)
    keys = [rare]
    if coverage > 0:
        often = hashes[kinds == 2]
        scattered = mix(often)
        for level in {n.bit_length(), (5 * n // 4).bit_length()}:
            subclass = scattered % np.uint64(max(1, (1 << level) >> 5))
            opens = np.zeros(len(often), bool)
            opens[np.unique(subclass, return_index=True)[1]] = True
            enough = np.flatnonzero(np.cumsum(~opens) >= coverage)
            upto = int(enough[0]) + 1 if len(enough) else len(often)
            order = np.argsort(subclass[:upto], kind="stable")
            sub, mixed = subclass[:upto][order], scattered[:upto][order]
            for apart in range(1, upto):
                same = np.flatnonzero(sub[apart:] == sub[:-apart])
                if not len(same):
                    break
                keys.append(mix(mixed[same] * np.uint64(0xD6E8FEB86659FD93) + mixed[same + apart] + np.uint64(level)))
    return np.unique(np.concatenate(keys))


def index_sets(docs: DataFrame, classes: Classes, chosen) -> DataFrame:
    """sid, src, n, m, keys, hashes of each set that could have a partner, once a task; m counts its repeated shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        src = TaskContext.get().partitionId() << 40
        for _, sets in _blocks(batches, chosen.value):
            rows: list[tuple] = []
            for s in sets:
                key = _digest(s)
                if key is None or key in seen:
                    continue
                seen.add(key)
                kinds = known.of(s)
                keys = index_keys(s, kinds)
                if len(keys):
                    rows.append((key, src + len(seen), len(s), int((kinds > 0).sum()), keys.view(np.int64), s.view(np.int64)))
            if rows:
                kinds_of = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)], ["sid", "src", "n", "m", "keys", "hashes"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "sid binary, src long, n long, m long, keys array<long>, hashes array<long>")


def _possible(n_a: str, m_a: str, n_b: str, m_b: str) -> Column:
    """Whether sizes, and the shingles that any other set has too, allow a similarity of 0.8."""
    shared = F.least(m_a, m_b)
    return 100 * shared >= 80 * (F.col(n_a) + F.col(n_b) - shared)


def overlaps(pairs: DataFrame, sets: DataFrame, kept: DataFrame) -> DataFrame:
    """pairs (a, b and what they carry) with both, the size of the overlap, and outside, the shingles of a that b lacks."""
    sides = [kept.select(F.col("sid").alias(x), F.col("src").alias(f"src_{x}")) for x in "ab"]
    pairs = materialise(pairs.join(sides[0], "a").join(sides[1], "b"), "pairs")
    wanted = materialise(pairs.select(F.col("src_a").alias("src")).union(pairs.select("src_b")).distinct(), "wanted")
    used = sets.select("src", "hashes").join(wanted, "src", "left_semi")
    for x in "ab":
        pairs = pairs.join(used.select(F.col("src").alias(f"src_{x}"), F.col("hashes").alias(f"set_{x}")), f"src_{x}")
    outside = F.array_except("set_a", "set_b")
    return pairs.withColumn("outside", outside).withColumn("both", (F.size("set_a") - F.size("outside")).cast("long")).drop("set_a", "set_b", "src_a", "src_b")


def _linked(n_a: str, n_b: str) -> Column:
    return 100 * F.col("both") >= 80 * (F.col(n_a) + F.col(n_b) - F.col("both"))


def roots(parents: DataFrame) -> DataFrame:
    """node, root of a forest given as (node, parent) without cycles, by pointer jumping."""
    at = materialise(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = materialise(at.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        at = step.select("node", "root")
        if step.where("moved").isEmpty():
            return at


def connected(edges: DataFrame) -> DataFrame:
    """node, root of an undirected graph (a, b): each node takes its smallest neighbour as parent, roots replace nodes, again."""
    total: DataFrame | None = None
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        found = roots(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        if total is None:
            total = found
        else:
            moved = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
            total = materialise(total.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(found), "components")
        for side in "ab":
            moved = found.select(F.col("node").alias(side), F.col("root").alias("above"))
            edges = edges.join(moved, side, "left").withColumn(side, F.coalesce("above", side)).drop("above")
        edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def attach(keyed: DataFrame, sets: DataFrame, kept: DataFrame) -> DataFrame:
    """sid, n, m, family, both, linked, outside for each set that has a pivot to be verified against."""
    rank = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("alone"), "sid", "n", "m")
    pivots = materialise(
        keyed.groupBy("key").agg(F.min(rank).alias("pivot")).select("key", F.col("pivot.sid").alias("b"), F.col("pivot.n").alias("n_b"), F.col("pivot.m").alias("m_b")),
        "pivots",
    )
    met = keyed.join(pivots, "key").where((F.col("sid") != F.col("b")) & _possible("n", "m", "n_b", "m_b"))
    shared = met.groupBy("sid", "n", "m", "b", "n_b").agg(F.count("*").alias("keys"))
    best = shared.groupBy(F.col("sid").alias("a"), "n", "m").agg(F.max(F.struct("keys", "b", "n_b")).alias("x")).select("a", "n", "m", "x.b", "x.n_b")
    found = overlaps(best, sets, kept)
    return materialise(found.select(F.col("a").alias("sid"), "n", "m", F.col("b").alias("family"), "both", _linked("n", "n_b").alias("linked"), "outside"), "attached")


def open_pairs(keyed: DataFrame, attached: DataFrame, stars: DataFrame) -> DataFrame:
    """a, n_a, root_a, b, n_b, root_b: the pairs of different components that may still be linked."""
    info = attached.select("sid", "family", "both", "linked").join(stars.withColumnRenamed("node", "sid"), "sid", "full")
    placed = materialise(
        keyed.join(info, "sid", "left").select(
            "key", "sid", "n", "m", F.coalesce("root", "sid").alias("root"), F.coalesce("family", "sid").alias("family"), "both", F.coalesce("linked", F.lit(True)).alias("linked"),
        ),
        "placed",
    )
    mixed = materialise(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"), "mixed")
    placed = materialise(placed.join(mixed, "key", "left_semi"), "open")
    members = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "m", "root", "both", "linked")]
    apart = F.col("root_a") != F.col("root_b")
    out = ["sid_a", "n_a", "root_a", "sid_b", "n_b", "root_b"]

    # Different families: pairs of families first, from the smaller one's members to the larger one's.
    families = materialise(
        placed.groupBy("key", "family").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("m").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")),
        "families",
    )
    other = families.select("key", *(F.col(c).alias(f"{c}_b") for c in ("family", "size", "least", "most", "m", "x", "y")))
    before = F.struct("size", "family") < F.struct(F.col("size_b").alias("size"), F.col("family_b").alias("family"))
    near = (5 * F.col("most") >= 4 * F.col("least_b")) & (5 * F.col("most_b") >= 4 * F.col("least")) & (180 * F.least("m", "m_b") >= 80 * (F.col("least") + F.col("least_b")))
    differ = F.least("x", "x_b") != F.greatest("y", "y_b")
    crossing = materialise(families.join(other, "key").where(before & near & differ).select("key", "family", "family_b", "least_b", F.col("m_b").alias("top_b"), F.col("x_b"), F.col("y_b")), "crossing")
    fits = (180 * F.least("m_a", "top_b") >= 80 * (F.col("n_a") + F.greatest(F.col("least_b"), F.floor(F.col("n_a") * 4 / 5)))) & ((F.col("root_a") != F.col("x_b")) | (F.col("root_a") != F.col("y_b")))
    one = crossing.join(placed.select("key", "family", *members("a")), ["key", "family"]).where(fits).select("key", "family_b", "sid_a", "n_a", "m_a", "root_a")
    two = placed.select("key", F.col("family").alias("family_b"), *members("b"))
    pairs = materialise(one, "smaller").join(two, ["key", "family_b"]).where(apart & _possible("n_a", "m_a", "n_b", "m_b")).select(out)

    # One family, a shingle shared outside its pivot.
    loose = materialise(attached.where("NOT linked").select("family").distinct(), "loose")
    rooted = attached.join(loose, "family", "left_semi").join(stars.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    outer = materialise(rooted.select("family", "sid", "n", "m", "root", "both", "linked", F.explode("outside").alias("shingle")), "outer")
    twice = materialise(outer.groupBy("family", "shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("family", "shingle"), "twice")
    outer = materialise(outer.join(twice, ["family", "shingle"], "left_semi"), "outer")
    left = outer.where("NOT linked").select("family", "shingle", *members("a"))
    met = left.join(outer.select("family", "shingle", *members("b")), ["family", "shingle"]).where(apart & _possible("n_a", "m_a", "n_b", "m_b"))
    pairs = pairs.unionByName(met.select(out))

    # One family, nothing shared outside: the other set is smaller than the pivot by enough.
    within = placed.where("both IS NOT NULL").withColumn("cap", F.floor(F.col("both") * 9 / 4) - F.col("n"))
    small = within.groupBy("key", "family").agg(F.min("n").alias("least"))
    askers = materialise(within.where("NOT linked").join(materialise(small, "small"), ["key", "family"]).where("cap >= least"), "askers").select("key", "family", *members("a"))
    bound = 180 * F.least("both_a", "both_b") >= 80 * (F.col("n_a") + F.col("n_b"))
    met = askers.join(within.select("key", "family", *members("b")), ["key", "family"]).where(apart & bound)
    pairs = pairs.unionByName(met.select(out))
    swap = F.col("sid_a") > F.col("sid_b")
    named = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{'' if c == 'sid' else c + '_'}{x}") for x, y in ("ab", "ba") for c in ("sid", "n", "root")]
    return pairs.select(named).distinct()


def set_components(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node (a sid), root: the component of each set that is linked with another."""
    spark = docs.sparkSession.sparkContext
    chosen = spark.broadcast(representatives(members))
    shingles = members.where("sid IS NOT NULL").groupBy("sid").agg(F.max("n_shingles").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sets = materialise(index_sets(docs, count_classes(docs, shingles, chosen), chosen), "sets")
    kept = materialise(sets.groupBy("sid").agg(F.min("src").alias("src")), "kept")
    single = sets.select("sid", "n", "m", F.explode("keys").alias("key"))
    several = materialise(single.groupBy("key").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y").select("key"), "several")
    keyed = materialise(single.join(several, "key", "left_semi").distinct(), "keyed")
    attached = attach(keyed, sets, kept)
    stars = roots(attached.where("linked").select(F.col("sid").alias("node"), F.col("family").alias("parent")))
    tried = overlaps(open_pairs(keyed, attached, stars), sets, kept)
    links = tried.where(_linked("n_a", "n_b")).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    merged = connected(materialise(links, "links"))
    joined = stars.join(merged.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return joined.unionByName(merged.join(stars.select("node"), "node", "left_anti"))


def component_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, n_shingles, sid of each row) and placed (sid, least doc_id, root: the component of each set)."""
    members = materialise(set_members(docs), "members")
    linked = set_components(docs, members)
    smallest = members.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    return members, materialise(smallest.join(linked.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "placed")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    members, placed = component_roots(docs)
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = materialise(placed.join(materialise(component, "component"), "root").select("sid", "component_id"), "of_set")
    return members.join(of_set, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest doc_id; rows without words stay.

    Rows are told apart by doc_id where it is unique. Rows without an id or with a repeated one are also judged by their own sets: of those
    that may stand for their component, one stays (an id before none, then the smallest hash of the row).
    """
    members, placed = component_roots(docs)
    component = materialise(placed.groupBy("root").agg(F.min("least").alias("keep")), "component")
    of_set = materialise(placed.join(component, "root").select("sid", "root", "keep"), "of_set")
    repeated = materialise(members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    dropped = members.join(of_set, "sid").where("doc_id <> keep").select("doc_id")
    out = docs.where("doc_id IS NOT NULL").join(materialise(dropped.unionByName(repeated).distinct(), "dropped"), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty() and members.where("doc_id IS NULL").isEmpty():
        return out
    odd = docs.where("doc_id IS NULL").unionByName(docs.join(repeated, "doc_id", "left_semi").select(docs.columns))
    held = with_sets(odd).join(of_set.toDF("__sid", "__root", "__keep"), "__sid", "left").where("__sid IS NULL OR __keep <=> doc_id")
    row = F.struct(*docs.columns)
    wordless = held.where("__sid IS NULL").select(docs.columns)
    chosen = held.where("__sid IS NOT NULL").groupBy("__root").agg(F.min_by(row, F.xxhash64(row)).alias("__row")).select("__row.*")
    return out.unionByName(wordless).unionByName(chosen)


def with_sets(docs: DataFrame) -> DataFrame:
    """docs with the digest of each row's set as __sid."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["n", "text"])
            sids = [_digest(s) for _, sets in _blocks(iter([numbered])) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sids, pa.binary())], [*batch.schema.names, "__sid"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__sid", BinaryType())]))
