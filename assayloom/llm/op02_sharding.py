"""Minimax contiguous sharding.

Texts are hashed into 65,536 ordered cells; equal texts share a cell, so a cell is an atomic group that no cut may split. The
smallest shard capacity for which a greedy left-to-right fill needs at most the wanted number of shards is found by binary
search, and the cuts are made there. Only the sizes of the cells (a fixed number) reach the driver.

A group of copies that outweighs an even share fixes the capacity for everybody; filling the other shards up to it would leave
some empty. Such a cell becomes a shard of its own and the cells on either side are partitioned again, so that the rest stays
even.

Edge cases: a null text counts as an empty one (size 1, CRC 0); equal texts always share a shard; repeated rows get a slot each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CELLS = 1 << 16
PARTS = 256


def greedy_cuts(prefix: list[int], lo: int, hi: int, capacity: int) -> list[int]:
    """Ends of the shards that a greedy fill of cells lo..hi-1 makes; prefix[i] is the size of the cells before i."""
    ends, at = [], lo
    while at < hi:
        at = min(hi, bisect_right(prefix, prefix[at] + capacity, at, hi + 1) - 1)
        ends.append(at)
    return ends


def smallest_capacity(prefix: list[int], lo: int, hi: int, shards: int, largest: int) -> int:
    low, high = max(largest, -(-(prefix[hi] - prefix[lo]) // shards)), prefix[hi] - prefix[lo]
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(prefix, lo, hi, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """shards - 1 ascending cell indexes at which a new shard begins."""
    prefix = [0, *accumulate(sizes)]

    def capacity(lo: int, hi: int, k: int) -> int:
        if lo == hi:
            return 0
        return smallest_capacity(prefix, lo, hi, k, max(sizes[lo:hi])) if k else prefix[-1] + 1

    def part(lo: int, hi: int, k: int) -> list[int]:
        if k == 1 or hi - lo <= 1:
            return [hi] * k
        giant, most = max(range(lo, hi), key=lambda i: sizes[i]), capacity(lo, hi, k)
        # The larger of the two sides falls and rises with the number of shards given to the left.
        left = min(range(k), key=lambda n: max(capacity(lo, giant, n), capacity(giant + 1, hi, k - 1 - n)))
        right = k - 1 - left
        if sizes[giant] * k <= prefix[hi] - prefix[lo] or max(capacity(lo, giant, left), capacity(giant + 1, hi, right)) > most:
            ends = greedy_cuts(prefix, lo, hi, most)
            return ends + [hi] * (k - len(ends))
        return (part(lo, giant, left) if left else []) + [giant + 1] + (part(giant + 1, hi, right) if right else [])

    ends = part(0, len(sizes), shards)
    ends[-1] = len(sizes)
    return ends[:-1]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
        ),
        "sizes",
    )
    sizes = [0] * CELLS
    for cell, size in rows.groupBy("cell").agg(F.sum("size")).collect():
        sizes[cell] = size
    shard = F.lit(0)
    for cut in minimax_cuts(sizes, shards):
        shard = shard + (F.col("cell") >= cut).cast("int")
    dealt = rows.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "part").count()
        .select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("nth", F.row_number().over(within).cast("long"))
        # shards * PARTS rows at most, whatever the input
        .join(F.broadcast(starts), ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
