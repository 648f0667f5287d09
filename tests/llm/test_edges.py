"""Nulls in any column, empty and long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import zlib

import pytest

from assayloom.llm import op01_decontamination, op02_sharding, op03_secrets, op04_chat, op05_topk, op06_quality, op07_urls, op09_html, op10_jaccard, queries

LONG = "word " * 30_000 + "end"
TEXTS = [(1, None), (2, ""), (3, "one two three"), (4, LONG), (4, LONG), (5, "a b c d e f g"), (None, "a b c d e f g"), (6, "  \n ")]
#: Names that the operators use inside.
CLASH = (
    "'x' AS shard", "1 AS size", "2 AS cell", "'k' AS key", "0 AS root", "1 AS at", "array(1) AS doc", "1 AS part", "'y' AS h", "1.5 AS score", "1 AS n",
    "'e' AS prefix", "'f' AS host", "'g' AS found", "1 AS `count`",
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", *CLASH)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


def test_sharding(docs, none):
    got = op02_sharding.shard_documents(docs).collect()
    assert len(got) == len(TEXTS)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(LONG.encode())}) == 1
    assert op02_sharding.shard_documents(none).count() == 0


def test_jaccard(docs, none):
    assert [r[:3] for r in by_id(op10_jaccard.jaccard_components(docs))] == [(None, 3, 5), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4), (4, 2, 4), (5, 3, 5), (6, 0, 6)]
    assert op10_jaccard.jaccard_components(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (None, "word"), (3, "a b c d e f g")], "item_id long, text string").selectExpr("*", "1 AS mask", "'s' AS seed", "0 AS item_at")
    got = sorted((r.doc_id or 0, r.item_id, r.overlap) for r in op01_decontamination.find_overlaps(docs, items).collect())
    assert got == [(0, 1, 7), (0, 3, 7), (5, 1, 7), (5, 3, 7)]
    assert op01_decontamination.find_overlaps(none, items).count() == 0
    assert op01_decontamination.find_overlaps(docs, items.where("false")).count() == 0


def test_secrets(docs, none):
    got = by_id(op03_secrets.scan(docs))
    assert len(got) == len(TEXTS) and all(r[1:4] == (0, 0, 0) and r[4] == hashlib.sha256(b"").hexdigest() and r[5] == "" for r in got)
    assert op03_secrets.scan(none).count() == 0
    assert by_id(op03_secrets.mask_documents(docs).select("doc_id", "text")) == sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = by_id(op06_quality.score_documents(docs, labels))
    assert len(got) == len(TEXTS) and all(0 <= r[1] <= 1 and r[2] == int(r[1] >= 0.3) for r in got)
    assert op06_quality.score_documents(none, labels).count() == 0
    assert {r.score for r in op06_quality.score_documents(docs, labels.where("false")).collect()} == {0.5}


def test_bpe(docs, none):
    got = by_id(queries.encode_documents(docs))
    assert sorted(r[3] for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS)
    assert queries.encode_documents(none).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, "user", "only"), (3, None, None, "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (None, 0, "assistant", "z")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS example", "'t' AS last")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in op04_chat.digest_chats(op04_chat.format_chats(chats)).collect()}
    assert got == {1: (2, 0), 2: (1, 0), 3: (3, 2), None: (1, 1)}
    assert op04_chat.format_chats(chats.where("false")).count() == 0


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [None, 1.0]), (6, [nan, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (50, [1e30, 0.0]), (100, [0.25, 0.0]), (100, [0.25, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS cell", "3 AS block")
    got = sorted(tuple(r) for r in op05_topk.top_k(v).collect())
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 100, 16384), (0, 4, 100, 16384), (100, 1, 0, 16384), (100, 2, 1, 8192), (100, 3, 2, 8192)]
    assert op05_topk.top_k(v.where("false")).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.COM/x?y"), (4, "http://www.Example.com/en/"), (5, "http://b.example.com/en/1"), (6, "http://c.net/es/#t"), (7, "http://a.com"), (7, "http://a.com"), (8, "http://xcom/y")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", *CLASH)
    got = [(r[0], r[1], r[2], r[3]) for r in by_id(op07_urls.judge_urls(pages))]
    assert got == [
        (1, "", "", None), (2, "", "", None), (3, "a.com", "/x", "com/"), (4, "www.example.com", "/en/", "www.example.com/en/"), (5, "b.example.com", "/en/1", "example.com/en/"),
        (6, "c.net", "/es/", "net/es/"), (7, "a.com", "", None), (7, "a.com", "", None), (8, "xcom", "/y", None),
    ]
    assert op07_urls.judge_urls(pages.where("false")).count() == 0


def test_html(spark):
    rows = [(1, "http://a.b/", None), (2, None, ""), (3, "http://a.b/1", "plain &lt;text&gt;"), (4, "http://a.b/2", "<article><p>x  y</p><p>z"), (4, "http://a.b/2", "<article><p>x  y</p><p>z"), (None, "u", "<p>q</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *CLASH)
    got = [(r[0], r[2], r[3]) for r in by_id(op09_html.extract(pages))]
    assert got == [(None, "q", 1), (1, "", 0), (2, "", 0), (3, "plain <text>", 12), (4, "x y\nz", 5), (4, "x y\nz", 5)]
    assert op09_html.extract(pages.where("false")).count() == 0
