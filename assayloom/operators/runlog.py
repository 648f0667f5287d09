"""Analytics of run journals: lineage, failures, redaction, retention, sharing, reviews and versions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..catalog import Tables, query
from ..sources import domain as D
from .scalars import _INTEGRITY, integrity_of, redact_json


@query("lin01_lineage", """
SELECT trace_id, count(*) FILTER (WHERE event = 'candidate_created') AS candidates, count(*) FILTER (WHERE event = 'candidate_transformed') AS transforms, count(*) FILTER (WHERE event = 'candidate_rejected') AS rejections, count(*) FILTER (WHERE event = 'candidate_merged') AS merges,
 string_agg(CAST(seq AS STRING), ',' ORDER BY seq) FILTER (WHERE event = 'failure') AS failures FROM journal GROUP BY trace_id""")
def lineage(t: Tables) -> DataFrame:
    n = lambda e: F.count_if(F.col("event") == e)
    failed = F.collect_list(F.when(F.col("event") == "failure", F.col("seq")))
    listed = F.array_join(F.transform(F.sort_array(failed), lambda s: s.cast("string")), ",")
    return t.journal.groupBy("trace_id").agg(
        n("candidate_created").alias("candidates"), n("candidate_transformed").alias("transforms"), n("candidate_rejected").alias("rejections"), n("candidate_merged").alias("merges"),
        F.nullif(listed, F.lit("")).alias("failures"),
    )


@query("lin02_orphans", "SELECT j.trace_id, j.candidate, j.parent, j.seq FROM journal j WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM journal p WHERE p.trace_id = j.trace_id AND p.candidate = j.parent AND p.seq < j.seq)")
def orphans(t: Tables) -> DataFrame:
    """Rows whose parent was not seen before: a join with the first row of each candidate, no pairs of rows."""
    first = t.journal.groupBy("trace_id", F.col("candidate").alias("parent")).agg(F.min("seq").alias("born"))
    rows = t.journal.where("parent IS NOT NULL").join(first, ["trace_id", "parent"], "left")
    return rows.where("born IS NULL OR born >= seq").select("trace_id", "candidate", "parent", "seq")


@query("lin03_failed_traces", "SELECT trace_id, bool_or(event = 'failure') OR bool_or(status IN ('failed', 'timeout', 'partial_timeout', 'cancelled')) AS failed FROM journal GROUP BY trace_id")
def failed_traces(t: Tables) -> DataFrame:
    bad = (F.col("event") == "failure") | F.col("status").isin("failed", "timeout", "partial_timeout", "cancelled")
    return t.journal.groupBy("trace_id").agg(F.bool_or(bad).alias("failed"))


@query("lin04_image_retention", """
WITH f AS (SELECT trace_id, bool_or(status = 'timeout' AND seq % 2 = 0) AS failed FROM journal GROUP BY trace_id)
SELECT j.seq, CASE WHEN f.failed THEN true ELSE stage IN ('stage-1', 'stage-2') AND seq % 3 <> 0 END AS kept FROM journal j JOIN f USING (trace_id)""")
def image_retention(t: Tables) -> DataFrame:
    """All images of failed traces, and of the others the critical ones that are not intermediate."""
    f = t.journal.groupBy("trace_id").agg(F.bool_or((F.col("status") == "timeout") & (F.col("seq") % 2 == 0)).alias("failed"))
    kept = F.col("failed") | (F.col("stage").isin("stage-1", "stage-2") & (F.col("seq") % 3 != 0))
    return t.journal.join(f, "trace_id").select("seq", kept.alias("kept"))


@query("lin05_aspect_warning", "SELECT seq, abs((size + 100) * 1000 - (cents + 100) * 1000) > 20 * (cents + 100) AS warned FROM journal")
def aspect_warning(t: Tables) -> DataFrame:
    """Ratios that differ by more than 2 %, in integers."""
    a, b = F.col("size") + 100, F.col("cents") + 100
    return t.journal.select("seq", (F.abs(a * 1000 - b * 1000) > 20 * b).alias("warned"))


@query("lin06_candidate_ids", "SELECT trace_id, seq, 'candidate-' || lpad(CAST(row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS STRING), 3, '0') AS id FROM journal WHERE event = 'candidate_created'")
def candidate_ids(t: Tables) -> DataFrame:
    n = F.row_number().over(W.partitionBy("trace_id").orderBy("seq")).cast("string")
    return t.journal.where("event = 'candidate_created'").select("trace_id", "seq", F.concat(F.lit("candidate-"), F.lpad(n, 3, "0")).alias("id"))


@query("lin07_expired_runs", "SELECT run_id, max(CAST(ts AS DATE)) < DATE '2024-01-25' AS expired FROM journal GROUP BY run_id")
def expired_runs(t: Tables) -> DataFrame:
    return t.journal.groupBy("run_id").agg((F.max(F.to_date("ts")) < F.lit("2024-01-25").cast("date")).alias("expired"))


@query("lin08_default_review", "SELECT seq, CASE WHEN event = 'failure' OR status = 'timeout' THEN 'needs review' WHEN status = 'odd' THEN 'mismatch' ELSE 'ok' END AS review FROM journal")
def default_review(t: Tables) -> DataFrame:
    review = F.when((F.col("event") == "failure") | (F.col("status") == "timeout"), "needs review").when(F.col("status") == "odd", "mismatch").otherwise("ok")
    return t.journal.select("seq", review.alias("review"))


@query("lin09_single_run", "SELECT trace_id, count(DISTINCT run_id) = 1 AS single FROM journal GROUP BY trace_id")
def single_run(t: Tables) -> DataFrame:
    return t.journal.groupBy("trace_id").agg((F.min("run_id") == F.max("run_id")).alias("single"))


@query("lin10_call_counts", "SELECT trace_id, coalesce(nullif(sum(CASE WHEN stage = 'stage-3' THEN size % 4 END), 0), count(*) FILTER (WHERE event = 'candidate_created'))::BIGINT AS calls FROM journal GROUP BY trace_id")
def call_counts(t: Tables) -> DataFrame:
    """The counted calls, else the number of their events."""
    counted = F.nullif(F.sum(F.when(F.col("stage") == "stage-3", F.col("size") % 4)), F.lit(0))
    return t.journal.groupBy("trace_id").agg(F.coalesce(counted, F.count_if(F.col("event") == "candidate_created")).alias("calls"))


def pick_within_budget(rows: pd.DataFrame) -> pd.DataFrame:
    """Images of one run in order; the first of a file that does not fit ends that file, and the total runs on over files."""
    total, stopped, kept = 0, set(), []
    for r in rows.sort_values(["candidate", "seq"]).itertuples():
        fits = r.candidate not in stopped and total + r.size <= 200_000
        if fits:
            total += r.size
        elif r.candidate not in stopped:
            stopped.add(r.candidate)
        kept.append((r.trace_id, r.seq, fits))
    return pd.DataFrame(kept, columns=["trace_id", "seq", "kept"])


@query("lin11_image_budget")
def image_budget(t: Tables) -> DataFrame:
    return t.journal.select("trace_id", "candidate", "seq", "size").groupBy("trace_id").applyInPandas(pick_within_budget, "trace_id long, seq long, kept boolean")


@query("lin12_sanitise", "SELECT event_id, '{\"note\":\"Token [REDACTED]\",\"Prompt\":\"[EXCLUDED FROM SHARE]\",\"at\":\"<user-home>/x.pdf in <repo>/run\",\"inner\":[{\"file_path\":\"[EXCLUDED FROM SHARE]\",\"props\":' || replace(props, ' ', '') || '}]}' AS details FROM events")
def sanitise(t: Tables) -> DataFrame:
    """JSON documents for a share: what forbidden keys hold goes, at any depth; secrets and the paths of this machine are masked."""
    raw = F.concat(F.lit('{"note":"Token abcdefgh-12345","Prompt":["p",{"x":1}],"at":"/home/me/x.pdf in /srv/repo/run","inner":[{"file_path":"/home/me/a","props":'), "props", F.lit("}]}"))
    clean = redact_json(raw, D.EXPORT_KEYS, "[EXCLUDED FROM SHARE]")
    return t.events.select("event_id", F.replace(F.replace(clean, F.lit("/srv/repo"), F.lit("<repo>")), F.lit("/home/me"), F.lit("<user-home>")).alias("details"))


_SHARED = "CASE event_id % 11 WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 1 THEN 'basic YWJj' WHEN 2 THEN concat('c:', chr(92), 'users', chr(92), 'me', chr(92), 'x') WHEN 3 THEN 'API-key = 5' WHEN 4 THEN 'bearer' ELSE props END"
_SHARED_FILE = "CASE event_id % 101 WHEN 0 THEN 'sheet.PDF' WHEN 1 THEN 'config.json' WHEN 2 THEN 'image.png' ELSE 'part.jsonl' END"


@query("lin13_unsafe_rows", f"""
WITH s AS (SELECT {_SHARED} AS text, {_SHARED_FILE} AS file, 5000 AS size FROM events)
SELECT count(*) FILTER (WHERE regexp_matches(lower(file), '\\.pdf$') OR file IN ('config.json', 'smu_cache.json', 'msds_cache_registry.json')) AS forbidden_files,
    count(*) FILTER (WHERE regexp_matches(file, '\\.(json|md|jsonl|txt)$') AND ({" OR ".join(f"regexp_matches(text, '(?i){p}')" for p in D.SECRET_TEXTS)})) AS unsafe, sum(size) > 52428800 AS too_large FROM s""")
def unsafe_rows(t: Tables) -> DataFrame:
    """A share is safe if it holds no forbidden file, no text with a secret, and no more than its limit."""
    text, file = F.expr(_SHARED), F.expr(_SHARED_FILE)
    secret = F.lit(False)
    for pattern in D.SECRET_TEXTS:
        secret = secret | text.rlike("(?i)" + pattern)
    return t.events.agg(
        F.count_if(F.lower(file).rlike(r"\.pdf$") | file.isin(*D.FORBIDDEN_FILES)).alias("forbidden_files"), F.count_if(file.rlike(r"\.(json|md|jsonl|txt)$") & secret).alias("unsafe"),
        (F.sum(F.lit(5000)) > D.SHARE_BYTES).alias("too_large"),
    )


@query("lin14_latest_success", "SELECT trace_id, max_by(candidate, seq) AS candidate, max(seq) AS seq FROM journal WHERE status = 'completed' AND event = 'candidate_selected' GROUP BY trace_id")
def latest_success(t: Tables) -> DataFrame:
    done = t.journal.where("status = 'completed' AND event = 'candidate_selected'")
    return done.groupBy("trace_id").agg(F.max_by("candidate", "seq").alias("candidate"), F.max("seq").alias("seq"))


@query("lin15_partial_result", "SELECT doc_id, CASE WHEN status = 'timeout' AND chars % 2 = 0 THEN 'partial_timeout' ELSE status END AS status, CASE WHEN status = 'timeout' AND chars % 2 <> 0 THEN '' ELSE product END AS components FROM document")
def partial_result(t: Tables) -> DataFrame:
    """What a timed-out run had found counts only if its matching was complete."""
    whole, late = F.col("chars") % 2 == 0, F.col("status") == "timeout"
    return t.document.select("doc_id", F.when(late & whole, "partial_timeout").otherwise(F.col("status")).alias("status"), F.when(late & ~whole, "").otherwise(F.col("product")).alias("components"))


@query("lin16_run_record", "SELECT doc_id, doc_type, status, file_name, file_hash, chars, images, product <> '' AS has_product, eligible, coalesce(nullif(product_seen, ''), product) AS shown_product FROM document")
def run_record(t: Tables) -> DataFrame:
    return t.document.select("doc_id", "doc_type", "status", "file_name", "file_hash", "chars", "images", (F.col("product") != "").alias("has_product"), "eligible", F.coalesce(F.nullif("product_seen", F.lit("")), "product").alias("shown_product"))


# Reviews and versions.


@query("ver01_upsert", """
WITH o AS (SELECT file_hash, max_by(product, doc_id) AS product, max_by(product_seen, doc_id) AS review FROM document WHERE doc_id % 2 = 0 GROUP BY file_hash), n AS (SELECT file_hash, max_by(product, doc_id) AS product FROM document WHERE doc_id % 2 = 1 GROUP BY file_hash)
SELECT coalesce(n.file_hash, o.file_hash) AS file_hash, coalesce(n.product, o.product) AS product, o.review AS user_review, coalesce(o.product, n.product) AS first_version FROM n FULL JOIN o ON n.file_hash = o.file_hash""")
def upsert(t: Tables) -> DataFrame:
    """The new record wins, an earlier review and the first version stay."""
    old = t.document.where("doc_id % 2 = 0").groupBy("file_hash").agg(F.max_by("product", "doc_id").alias("was"), F.max_by("product_seen", "doc_id").alias("user_review"))
    new = t.document.where("doc_id % 2 = 1").groupBy("file_hash").agg(F.max_by("product", "doc_id").alias("now"))
    return new.join(old, "file_hash", "full").select("file_hash", F.coalesce("now", "was").alias("product"), "user_review", F.coalesce("was", "now").alias("first_version"))


_EDITS = "e AS (SELECT trace_id AS hash, size % 5 AS idx, max_by(candidate, seq) AS value, max(seq) AS at FROM journal WHERE event = 'candidate_transformed' GROUP BY ALL)"


@query("ver02_edits", f"WITH {_EDITS} SELECT c.doc_id, c.seq, coalesce(e.value, c.cas) AS cas, CASE WHEN e.value IS NULL THEN c.content END AS derived FROM component c LEFT JOIN e ON e.hash = c.doc_id AND e.idx = c.page")
def edits(t: Tables) -> DataFrame:
    """The latest edit of a cell wins; an edited number clears what was derived from it."""
    e = t.journal.where("event = 'candidate_transformed'").groupBy(F.col("trace_id").alias("doc_id"), (F.col("size") % 5).alias("page")).agg(F.max_by("candidate", "seq").alias("value"))
    return t.component.join(e, ["doc_id", "page"], "left").select("doc_id", "seq", F.coalesce("value", "cas").alias("cas"), F.when(F.col("value").isNull(), F.col("content")).alias("derived"))


@query("ver03_restore", "WITH r AS (SELECT trace_id, max(seq) AS restored FROM journal WHERE event = 'failure' GROUP BY trace_id) SELECT j.trace_id, j.seq FROM journal j LEFT JOIN r USING (trace_id) WHERE j.event = 'candidate_transformed' AND (r.restored IS NULL OR j.seq > r.restored)")
def restore(t: Tables) -> DataFrame:
    """Edits older than the last restore are gone."""
    r = t.journal.where("event = 'failure'").groupBy("trace_id").agg(F.max("seq").alias("restored"))
    e = t.journal.where("event = 'candidate_transformed'").join(r, "trace_id", "left")
    return e.where("restored IS NULL OR seq > restored").select("trace_id", "seq")


@query("ver04_multi_selection", """
WITH s AS (SELECT c.doc_id, m.sort_code, m.name, m.special, m.permit, min(c.seq) AS first FROM component c JOIN master m USING (cas) WHERE c.page = 1 GROUP BY ALL), n AS (SELECT doc_id, name, min(first) AS first FROM s GROUP BY ALL)
SELECT s.doc_id, string_agg(sort_code, ';' ORDER BY s.first, sort_code, s.name) AS codes, bool_or(special) AS special, bool_or(permit) AS permit, any_value(x.names) AS names FROM s JOIN (SELECT doc_id, string_agg(name, ' / ' ORDER BY first, name) AS names FROM n GROUP BY doc_id) x USING (doc_id) GROUP BY s.doc_id""")
def multi_selection(t: Tables) -> DataFrame:
    s = t.component.where("page = 1").select("doc_id", "seq", "cas").join(t.master.select("cas", "sort_code", "name", "special", "permit"), "cas").groupBy("doc_id", "sort_code", "name", "special", "permit").agg(F.min("seq").alias("first"))
    join = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", *c))), lambda x: x[c[0]]), sep)
    names = s.groupBy("doc_id", "name").agg(F.min("first").alias("first")).groupBy("doc_id").agg(join(["name"], " / ").alias("names"))
    return s.groupBy("doc_id").agg(join(["sort_code", "name"], ";").alias("codes"), F.bool_or("special").alias("special"), F.bool_or("permit").alias("permit")).join(names, "doc_id")


@query("ver05_auto_apply", """
WITH n AS (SELECT c.doc_id, c.seq, c.cas, count(m.ord) AS candidates, min(m.ord) AS sole, count(*) FILTER (WHERE m.twa = CAST(c.quantity AS STRING)) AS limit_hits, min(m.ord) FILTER (WHERE m.twa = CAST(c.quantity AS STRING)) AS limit_ord FROM component c LEFT JOIN master m USING (cas) GROUP BY c.doc_id, c.seq, c.cas)
SELECT doc_id, seq, CASE WHEN candidates = 1 THEN 'auto' WHEN candidates = 0 THEN 'none' WHEN limit_hits = 1 THEN 'limit' ELSE 'pending' END AS state, CASE WHEN candidates = 1 THEN sole WHEN candidates > 1 AND limit_hits = 1 THEN limit_ord END AS profile FROM n""")
def auto_apply(t: Tables) -> DataFrame:
    """One candidate is applied; of several, the one whose limit matches, if it is the only one; else it stays pending."""
    hit = F.when(F.col("twa") == F.col("quantity").cast("string"), F.col("ord"))
    n = t.component.join(t.master.select("cas", "ord", "twa"), "cas", "left").groupBy("doc_id", "seq").agg(F.count("ord").alias("n"), F.min("ord").alias("only"), F.count(hit).alias("hits"), F.min(hit).alias("hit"))
    state = F.when(F.col("n") == 1, "auto").when(F.col("n") == 0, "none").when(F.col("hits") == 1, "limit").otherwise("pending")
    return n.select("doc_id", "seq", state.alias("state"), F.when(F.col("n") == 1, F.col("only")).when((F.col("n") > 1) & (F.col("hits") == 1), F.col("hit")).alias("profile"))


@query("ver06_next_pending", "WITH p AS (SELECT trace_id, seq FROM journal WHERE status = 'timeout') SELECT trace_id, count(*) AS pending, coalesce(min(seq) FILTER (WHERE seq > 5000), min(seq)) AS next FROM p GROUP BY trace_id")
def next_pending(t: Tables) -> DataFrame:
    """The next one after the current row, around the end to the first."""
    p = t.journal.where("status = 'timeout'")
    return p.groupBy("trace_id").agg(F.count("*").alias("pending"), F.coalesce(F.min(F.when(F.col("seq") > 5000, F.col("seq"))), F.min("seq")).alias("next"))


@query("ver07_promotion", """
WITH h AS (SELECT file_hash, bool_or(status <> 'success') AS was_bad, max_by(status, doc_id) = 'success' AS now_good FROM document GROUP BY file_hash), g AS (SELECT DISTINCT 'h' || CAST(o_custkey AS STRING) AS file_hash FROM orders WHERE o_custkey % 4 = 0)
SELECT file_hash, 1000 + row_number() OVER (ORDER BY file_hash) AS golden_id FROM h WHERE was_bad AND now_good AND file_hash NOT IN (SELECT file_hash FROM g)""")
def promotion(t: Tables) -> DataFrame:
    """New golden cases get the numbers after the largest used. Running numbers over ranges, then their offsets, not one sort."""
    h = t.document.groupBy("file_hash").agg(F.bool_or(F.col("status") != "success").alias("bad"), (F.max_by("status", "doc_id") == "success").alias("good"))
    golden = t.orders.where("o_custkey % 4 = 0").select(F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("file_hash"))
    new = h.where("bad AND good").join(golden, "file_hash", "left_anti").select("file_hash", F.substring("file_hash", 1, 3).alias("head"))
    before = new.groupBy("head").count().select("head", F.coalesce(F.sum("count").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("head").orderBy("file_hash"))
    return new.withColumn("nth", nth).join(F.broadcast(before), "head").select("file_hash", (F.lit(1000) + F.col("before") + F.col("nth")).alias("golden_id"))


@query("ver08_correction_reasons", f"""
WITH {D.values_sql("d", "cas, reason, n", tuple((c, r, n) for n, (c, r) in enumerate(D.REASONS)))}, {D.values_sql("w", "word", tuple((x,) for x in D.DONE_WORDS))},
c AS (SELECT doc_id, string_agg(cas || '(' || content || ')', '; ' ORDER BY seq) AS chain, string_agg(name, '; ' ORDER BY seq) AS corrected FROM chemical GROUP BY doc_id),
m AS (SELECT doc_id, chain, EXISTS (SELECT 1 FROM w WHERE contains(c.corrected, w.word)) AS done FROM c)
SELECT doc_id, string_agg(CASE WHEN done THEN '✔ [교정 완료] ' ELSE '• ' END || reason, chr(10) ORDER BY n) AS reasons, done FROM m JOIN d ON contains(m.chain, d.cas) GROUP BY doc_id, done""")
def correction_reasons(t: Tables) -> DataFrame:
    """The reasons of all numbers in a document's chain, one a line, marked as completed where the corrected text holds one of some words."""
    by = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", x.alias("x")))), lambda r: r["x"]), "; ")
    rows = t.chemical.groupBy("doc_id").agg(by(F.concat("cas", F.lit("("), "content", F.lit(")"))).alias("chain"), by(F.col("name")).alias("corrected"))
    done = F.exists(F.array(*map(F.lit, D.DONE_WORDS)), lambda w: F.contains("corrected", w))
    mark = F.when(F.col("done"), D.DONE_MARK).otherwise(D.OPEN_MARK)
    reasons = F.concat_ws("\n", *(F.when(F.contains("chain", F.lit(c)), F.concat(mark, F.lit(r))) for c, r in D.REASONS))
    return rows.withColumn("done", done).select("doc_id", reasons.alias("reasons"), "done").where("reasons <> ''")


@query("ver09_light_transition", f"WITH i AS ({_INTEGRITY}) SELECT i.doc_id, CASE WHEN NOT coalesce(bad, false) AND i.product_seen <> '' THEN '🟢' WHEN d.status = 'failed' THEN '🔴' WHEN d.status = 'timeout' THEN '🟡' ELSE '🟢' END AS light FROM i JOIN document d USING (doc_id)")
def light_transition(t: Tables) -> DataFrame:
    """A full score turns the light green, else an earlier red or yellow stays."""
    light = F.when(F.col("score") == 100, "🟢").when(F.col("status") == "failed", "🔴").when(F.col("status") == "timeout", "🟡").otherwise("🟢")
    return integrity_of(t).select("doc_id", light.alias("light"))


@query("ver10_guidance", """
WITH b AS (SELECT cas, min_by(ord, (TRY_CAST(twa AS INTEGER), ord)) AS best FROM master WHERE TRY_CAST(twa AS INTEGER) > 0 GROUP BY cas)
SELECT m.ord, CASE WHEN b.best = m.ord THEN '★추천 ' ELSE '' END || CASE WHEN special THEN '[특별]' WHEN permit THEN '[허가]' ELSE '' END AS tip FROM master m LEFT JOIN b USING (cas)""")
def guidance(t: Tables) -> DataFrame:
    limit = F.col("twa").try_cast("int")
    best = t.master.where(limit > 0).groupBy("cas").agg(F.min_by("ord", F.struct(limit.alias("l"), "ord")).alias("best"))
    tip = F.concat(F.when(F.col("best") == F.col("ord"), "★추천 ").otherwise(""), F.when(F.col("special"), "[특별]").when(F.col("permit"), "[허가]").otherwise(""))
    return t.master.join(best, "cas", "left").select("ord", tip.alias("tip"))


@query("ver11_attribution", "SELECT seq, CASE WHEN status = 'odd' THEN 'CALL_ERROR' WHEN status = 'timeout' THEN 'NO_RESPONSE' WHEN cents < 1000 THEN 'AI_NO_HARVEST' WHEN event <> 'candidate_selected' THEN 'NOT_APPLIED_TO_FINAL_RESULT' ELSE '' END AS discard_reason FROM journal")
def attribution(t: Tables) -> DataFrame:
    reason = (
        F.when(F.col("status") == "odd", "CALL_ERROR").when(F.col("status") == "timeout", "NO_RESPONSE").when(F.col("cents") < 1000, "AI_NO_HARVEST")
        .when(F.col("event") != "candidate_selected", "NOT_APPLIED_TO_FINAL_RESULT").otherwise("")
    )
    return t.journal.select("seq", reason.alias("discard_reason"))


@query("ver12_false_green", "WITH n AS (SELECT doc_id, count(*) AS components, count(DISTINCT cas) AS numbers FROM component GROUP BY doc_id) SELECT d.doc_id, n.components, n.numbers FROM document d JOIN n USING (doc_id) WHERE d.status = 'success' AND n.components <> n.numbers")
def false_green(t: Tables) -> DataFrame:
    n = t.component.groupBy("doc_id", "cas").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("components"), F.count("*").alias("numbers"))
    return t.document.where("status = 'success'").join(n.where("components <> numbers"), "doc_id").select("doc_id", "components", "numbers")


@query("ver13_provider_order", "SELECT doc_id, CASE WHEN doc_type = 'image' THEN 'b' ELSE 'a,b' END AS providers FROM document")
def provider_order(t: Tables) -> DataFrame:
    return t.document.select("doc_id", F.when(F.col("doc_type") == "image", "b").otherwise("a,b").alias("providers"))


@query("ver14_backup_name", "SELECT doc_id, regexp_replace(file_name, '\\.pdf$', '') || '_' || strftime(day, '%Y%m%d') || '.pdf' AS backup FROM document")
def backup_name(t: Tables) -> DataFrame:
    return t.document.select("doc_id", F.concat(F.regexp_replace("file_name", r"\.pdf$", ""), F.lit("_"), F.date_format("day", "yyyyMMdd"), F.lit(".pdf")).alias("backup"))
