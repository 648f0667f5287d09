"""The stages of the pipeline against brute force, and on rows that are null, empty, repeated or carry further columns."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from assayloom.llm import op03_secrets, op06_quality, op08_bpe, queries
from tests.llm.test_operators import brute_components

STAGE = dict(corpus_pipeline.STAGES)
CLASH = ("1 AS keep", "'r' AS root", "1 AS sid", "'h' AS doc_no", "2 AS n", "'x' AS item", "3 AS at", "4 AS ids", "1.5 AS score")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASH)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def test_near_duplicates_keeps_by_row(spark, small):
    a, b = "the quick brown fox jumps over the lazy dog", "an entirely different text of more than five words"
    rows = [(1, a), (1, a), (2, b), (2, a), (None, a)]
    assert pairs(STAGE["near_duplicates"](spark, frame(spark, rows), small)) == [(1, a), (2, b)]
    assert pairs(STAGE["near_duplicates"](spark, frame(spark, [(None, a), (None, a), (None, b)]), small)) == [(None, b), (None, a)]
    rows = [(5, None), (5, None), (None, ""), (6, " \n"), (7, b), (7, b), (8, b)]
    assert pairs(STAGE["near_duplicates"](spark, frame(spark, rows), small)) == [(None, ""), (5, None), (5, None), (6, " \n"), (7, b)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, small, name):
    item = next(r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").collect() if r.text)
    long = " ".join(f"w{i}" for i in range(40_000)) + " token = abcdefgh12345678"
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (None, f"so {item} it is"), (None, None), (9, f"so {item} it is"), (9, "clean words only and nothing else at all")]
    docs = frame(spark, rows)
    got = STAGE[name](spark, docs, small)
    none = STAGE[name](spark, docs.where("false"), small)
    assert none.count() == 0
    if name != "tokens":
        assert got.columns == docs.columns and set(pairs(got)) <= set(rows) or name == "secrets"
    if name == "decontamination":
        assert pairs(got) == pairs(frame(spark, [r for r in rows if not (r[1] or "").startswith("so ")]))
    if name == "secrets":
        assert [t for _, t in pairs(got) if t and t.endswith("[SECRET]")] == [long[: long.index("token")] + op03_secrets.MASK] * 2 and got.count() == len(rows)
    if name == "tokens":
        assert set(got.columns) == {*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"} and got.count() == len(rows)
        assert {(r.doc_id, r.text) for r in got.collect()} == set(rows)


def test_pipeline_brute_force(spark, small):
    """Each stage by its plain rule on what the stage before kept, down to token ids that decode to the masked text."""
    with open(public_tokenizers.path(queries.TOKENIZER), "rb") as f:
        ranks = op08_bpe.Bpe.from_lines(f.read(), public_tokenizers.PATTERN).ranks
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").where(~queries.held_out())
    good = {r.doc_id for r in op06_quality.score_documents(docs, labels).where("score >= 0.3").collect()}
    kept = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    placed = brute_components([t or "" for _, t in kept])
    kept = [kept[i] for i, (_, root) in placed.items() if i == root]
    words = lambda text: [w for w in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()]
    grams = {tuple(words(r.text)[i : i + 13]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() for i in range(len(words(r.text)) - 12)}
    held = [(d, t) for d, t in kept if not any(tuple(words(t)[i : i + 13]) in grams for i in range(len(words(t)) - 12))]
    masked = {d: op03_secrets.mask(t or "", op03_secrets.scan_texts([t or ""], op03_secrets.trained())[0][1]) for d, t in held}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) <= set(masked) and len(masked) - len(got) <= 2  # overlaps with substitutions go too
    for doc_id, r in got.items():
        assert r.text == masked[doc_id] and r.ids == other.encode_ordinary(r.text) and other.decode(r.ids) == r.text and r.n_tokens == len(r.ids)
