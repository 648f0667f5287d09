"""The registered queries of this subpackage, each over its whole table, and the SQL that should give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_decontamination, op02_sharding, op03_secrets, op04_chat, op05_topk, op06_quality, op07_urls, op08_bpe, op09_html, op10_jaccard
from .common import table

#: The conversation that shows the escapes, beside those of the table.
EXTRA_CHAT = r"\### Assistant: </turn> ok"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op03_secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_CHAT).alias("text"),
    )
    return op04_chat.digest_chats(op04_chat.format_chats(chats.unionByName(extra)))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_topk.top_k(table(spark, sf_dir, "embeddings"))


def held_out() -> Column:
    """Whether a label is kept from learning."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = op06_quality.score_documents(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def encode_documents(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), keep_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return op08_bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, carry, keep_ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_html.extract(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_sharding, op3_secrets, op4_chat, op5_topk, op6_quality, op7_urls, op8_bpe, op9_html, op10_jaccard_join)}

_CHAT_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
        4 + length(role) + 2 + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l')) + 9 AS width
    FROM c
), p AS (SELECT *, sum(width) OVER (PARTITION BY conv_id ORDER BY n) AS prefix FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR n = turns) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_DECONTAMINATION_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS doc FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS item FROM benchmark),
m(mask, span, o) AS (VALUES (0, 7, [1, 2, 3, 5, 7]), (1, 7, [1, 2, 4, 6, 7]), (2, 8, [1, 3, 4, 7, 8])),
dw AS (SELECT doc_id, unnest(range(0, len(doc))) AS pos FROM d),
ds AS (SELECT doc_id, pos, mask, list_transform(o, lambda x: doc[pos + x]) AS seed FROM dw JOIN d USING (doc_id), m WHERE pos + span <= len(doc)),
bw AS (SELECT item_id, unnest(range(0, len(item))) AS item_at FROM b),
bs AS (SELECT item_id, item_at, mask, list_transform(o, lambda x: item[item_at + x]) AS seed FROM bw JOIN b USING (item_id), m WHERE item_at + span <= len(item)),
h AS (SELECT DISTINCT doc_id, item_id, pos, item_at FROM ds JOIN bs USING (mask, seed)),
a AS (
    SELECT doc_id, item_id, pos - item_at AS doc_at, len(item) AS n,
        list_transform(range(greatest(item_at - 12, 0), least(item_at + 12, len(item) - 1) + 1), lambda j: CASE WHEN pos - item_at + j >= 0 AND doc[pos - item_at + j + 1] = item[j + 1] THEN 1 ELSE 0 END) AS agree,
        len(list_filter(range(0, len(item)), lambda j: pos - item_at + j >= 0 AND doc[pos - item_at + j + 1] = item[j + 1])) AS overlap
    FROM h JOIN d USING (doc_id) JOIN b USING (item_id)
), w AS (
    SELECT *, list_max(list_transform(range(0, greatest(len(agree) - least(n, 13), 0) + 1), lambda k: list_sum(agree[k + 1 : k + least(n, 13)]))) AS best FROM a
)
SELECT doc_id, item_id, CAST(max(overlap) AS INTEGER) AS overlap, CAST(max(n) AS INTEGER) AS item_tokens,
    CAST(arg_max(doc_at, overlap * 1000000000 - doc_at) AS INTEGER) AS doc_at
FROM w WHERE best >= CASE WHEN n >= 13 THEN 11 ELSE ceil(n * 0.8) END GROUP BY doc_id, item_id
"""

_JACCARD_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS ws
    FROM documents
), u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS words FROM w),
g AS (
    SELECT doc_id, words, i, x, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q || ' ' || lead(x, 3) OVER q || ' ' || lead(x, 4) OVER q AS five
    FROM u WINDOW q AS (PARTITION BY doc_id ORDER BY i)
), e AS (
    SELECT DISTINCT doc_id, five AS x FROM g WHERE five IS NOT NULL
    UNION ALL SELECT doc_id, string_agg(x, ' ' ORDER BY i) FROM g WHERE words < 5 GROUP BY doc_id
), n AS (SELECT doc_id, count(e.x) AS n FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
c AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT c.a AS doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(c.b) AS component_id FROM c JOIN n ON n.doc_id = c.a GROUP BY c.a
"""

#: The others draw on hashes, models or a tokenizer that SQL lacks; they are tested against brute force, exactness or held-out rows.
ORACLE_SQL = {
    "op1_decontamination": _DECONTAMINATION_SQL,
    "op4_chat": _CHAT_SQL,
    "op5_topk": _TOPK_SQL,
    "op10_jaccard_join": _JACCARD_SQL,
}
