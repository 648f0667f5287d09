"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the tokens that a fixed mask selects in a short window, so a substitution at an ignored position does not
hide an overlap. Seeds of all windows of all benchmark items are joined with those of all windows of the documents. Around each
hit the two texts are aligned, and the overlap counts if some window of WINDOW aligned tokens that holds the hit agrees in
LEAST of them (for items shorter than WINDOW: in four fifths of the item).

Windows of documents first pass a bit map of the benchmark's seeds (a Bloom filter of one hash and fixed size), inside the scan
stage; only what passes is joined. Seeds and items are tables of their own: a seed's row holds the number of its item and its
place, so an item's tokens are held once, however many seeds it has. While both tables take at most BROADCAST_BYTES they are
broadcast, and the document's tokens never leave the stage that made them. Of a larger benchmark only each window that passed, with the
tokens around it, is shuffled; equal ones (a passage that many documents share) are first made one, so a frequent seed is verified
once for each different surrounding; the whole overlap is counted for the documents that have a verified one.

The masks miss items shorter than themselves, and some overlaps of items shorter than WINDOW. Where the benchmark has such items,
they are also joined whole, by a seed for each set of positions that may differ (a fifth of the item at most), so none is missed.

Edge cases: tokens are runs of letters and digits, lower-cased; null and empty texts have none; an item of one token is not
looked for; repeated rows of a document or equal items are one match each id; rows with a null doc_id or
item_id are matched under null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: 1: the token counts, 0: it is ignored.
MASKS = ("1110101", "1101011", "10110011")
WINDOW, LEAST = 13, 11
MAP_BITS = 22
BROADCAST_BYTES = 64_000_000
#: Bytes of a token's rows once broadcast: a seed of each mask, and the token itself.
TOKEN_BYTES = 64 * len(MASKS) + 8
#: Tokens around a window's first that its verification can reach.
BEFORE, AFTER = WINDOW - 1, WINDOW + max(map(len, MASKS))


def token_hashes(text: Column) -> Column:
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.xxhash64(t))


def seeds(hashes: str, at: str) -> Column:
    """The seed of each mask for the window that begins at index at; null where the window does not fit."""
    h, i = F.col(hashes), F.col(at)
    return F.array(*(
        F.when(i + len(mask) <= F.size(h), F.xxhash64(F.lit(k), *(F.get(h, i + o) for o, bit in enumerate(mask) if bit == "1")))
        for k, mask in enumerate(MASKS)
    ))


def numbered_items(benchmark: DataFrame) -> DataFrame:
    """item_no (a hash of all the rest), item_id, item (token hashes); equal rows are one."""
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
    return items.select(F.xxhash64("item_id", "item").alias("item_no"), "item_id", "item").dropDuplicates(["item_no"])


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """seed, mask, item_no, item_at: one row for each mask and window of each item."""
    return (
        items.select("item_no", "item", F.posexplode("item").alias("item_at", "_"))
        .select("item_no", "item_at", F.posexplode(seeds("item", "item_at")).alias("mask", "seed"))
        .where("seed IS NOT NULL")
    )


def seed_map(found: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """One row: 2**bits bits in an array of longs, those of the seeds set."""
    slot = F.shiftrightunsigned("seed", 64 - bits)
    words = found.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(%s & 63 AS int))" % f"shiftrightunsigned(seed, {64 - bits})")).alias("set"))
    every = found.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "word").join(words, "word", "left")
    ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0)).alias("set"))))
    return every.agg(F.transform(ordered, lambda x: x["set"]).alias("map"))


def short_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """doc_id, item_id, overlap, item_tokens, doc_at where an item of 2 to WINDOW - 1 tokens agrees in all but a fifth of its tokens; it may
    hang over an end of the document by as many. None if there is no such item."""
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).where(F.size("item").between(2, WINDOW - 1))
    lengths = sorted(r[0] for r in items.select(F.size("item")).distinct().collect())  # WINDOW - 1 at most
    if not lengths:
        return None
    kept = [(n, [o for o in range(n) if o not in free]) for n in lengths for free in combinations(range(n), n // 5)]
    masks = ", ".join(f"named_struct('m', {m}, 'n', {n}, 'o', array({', '.join(map(str, o))}))" for m, (n, o) in enumerate(kept))

    def seeded(tokens: str, fits: str) -> Column:
        return F.expr(
            f"inline(transform(filter(array({masks}), x -> {fits} AND get({tokens}, x.o[0]) IS NOT NULL AND get({tokens}, array_max(x.o)) IS NOT NULL),"
            f" x -> named_struct('mask', x.m, 'seed', xxhash64(x.m, transform(x.o, o -> get({tokens}, o))))))"
        )

    # Of a document only the window goes on, with nulls beyond its ends.
    window = f"named_struct('at', at, 'w', transform(sequence(0, {lengths[-1] - 1}), k -> get(doc, at + k)))"
    windows = docs.select("doc_id", token_hashes(F.col("text")).alias("doc")).where(F.size("doc") > 0)
    windows = windows.select("doc_id", F.expr(f"inline(transform(sequence(-{lengths[-1] // 5}, size(doc) - 1), at -> {window}))"))
    hits = windows.select("doc_id", "at", "w", seeded("w", "true")).join(items.select("item_id", "item", seeded("item", "x.n = size(item)")), ["mask", "seed"])
    size = F.size("item")
    same = F.expr("size(filter(sequence(0, size(item) - 1), k -> get(w, k) = get(item, k)))")
    return hits.where(same >= F.ceil(size * 0.8)).select("doc_id", "item_id", same.alias("overlap"), size.alias("item_tokens"), F.col("at").alias("doc_at"))


def _around(doc: str, at: str, low: str, high: str) -> str:
    """SQL: whether the tokens low .. high of the item agree with those of doc, if item_at is at index at there; 1 or 0 each."""
    return f"transform(sequence({low}, {high}), j -> if({at} - item_at + j >= 0 AND get({doc}, {at} - item_at + j) = get(item, j), 1, 0))"


def _verified(hits: DataFrame, doc: str, at: str) -> DataFrame:
    """The hits around which some window agrees: at is the index in doc of the token at item_at."""
    size = F.size("item")
    agree = F.expr(_around(doc, at, f"greatest(item_at - {WINDOW - 1}, 0)", f"least(item_at + {WINDOW - 1}, size(item) - 1)"))
    best = F.expr("array_max(transform(sequence(0, greatest(size(agree) - width, 0)), k -> aggregate(slice(agree, k + 1, width), 0, (n, x) -> n + x)))")
    needed = F.when(size >= WINDOW, LEAST).otherwise(F.ceil(size * 0.8))
    return hits.withColumn("agree", agree).withColumn("width", F.least(size, F.lit(WINDOW))).where(best >= needed).drop("agree", "width")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, overlap (aligned tokens that agree), item_tokens, doc_at: the best verified overlap of each pair."""
    items = materialise(numbered_items(benchmark), "items")
    probes = benchmark_seeds(items)
    at = F.col("at")
    windows = docs.select("doc_id", token_hashes(F.col("text")).alias("doc")).select("doc_id", "doc", F.posexplode("doc").alias("at", "_"))
    tests = []
    for k, mask in enumerate(MASKS):
        seed = F.xxhash64(F.lit(k), *(F.get("doc", at + o) for o, bit in enumerate(mask) if bit == "1"))
        slot = F.shiftrightunsigned(seed, 64 - MAP_BITS)
        word = F.get(seed_map(probes).scalar(), F.shiftright(slot, 6).cast("int"))
        tests.append((at + len(mask) <= F.size("doc")) & (F.getbit(word, slot.bitwiseAND(63).cast("int")) == 1))
    passed = windows.where(tests[0] | tests[1] | tests[2])
    whole = F.expr("aggregate(" + _around("doc", "at", "0", "size(item) - 1") + ", 0, (n, x) -> n + x)").alias("overlap")
    out = ["doc_id", "item_id", whole, F.size("item").alias("item_tokens")]
    tokens = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    if tokens * TOKEN_BYTES <= broadcast_bytes:
        hits = passed.select("doc_id", "doc", "at", F.posexplode(seeds("doc", "at")).alias("mask", "seed")).where("seed IS NOT NULL")
        hits = hits.join(F.broadcast(probes), ["mask", "seed"]).join(F.broadcast(items), "item_no")
        found = _verified(hits, "doc", "at").select(*out, (at - F.col("item_at")).alias("doc_at"))
    else:
        # The tokens around, with nulls beyond the document's ends; whence them: the document's number and the place.
        around = F.expr(f"transform(sequence(-{BEFORE}, {AFTER}), k -> if(at + k >= 0, get(doc, at + k), null))")
        places = materialise(passed.select(F.xxhash64("doc_id", "doc").alias("doc_no"), "at", around.alias("around")).withColumn("around_no", F.xxhash64("around")), "places")
        kinds = places.select("around_no", "around").dropDuplicates(["around_no"]).withColumn("start", F.lit(BEFORE))
        hits = kinds.select("around_no", "around", "start", F.posexplode(seeds("around", "start")).alias("mask", "seed")).where("seed IS NOT NULL")
        hits = _verified(hits.join(probes, ["mask", "seed"]).join(items, "item_no"), "around", "start").select("around_no", "item_no", "item_at")
        verified = materialise(
            materialise(hits.distinct(), "hits").join(places.select("doc_no", "at", "around_no"), "around_no").select("doc_no", "item_no", (at - F.col("item_at")).alias("doc_at")).distinct(), "verified"
        )
        tokenised = docs.select("doc_id", token_hashes(F.col("text")).alias("doc")).withColumn("doc_no", F.xxhash64("doc_id", "doc"))
        found = tokenised.dropDuplicates(["doc_no"]).join(verified, "doc_no").join(items, "item_no").withColumn("at", F.col("doc_at")).withColumn("item_at", F.lit(0)).select(*out, "doc_at")
    short = short_overlaps(docs, benchmark)
    return (
        (found if short is None else found.unionByName(short)).groupBy("doc_id", "item_id")
        .agg(F.max("overlap").alias("overlap"), F.max("item_tokens").alias("item_tokens"), F.max_by("doc_at", F.struct("overlap", F.negative("doc_at"))).alias("doc_at"))
    )
