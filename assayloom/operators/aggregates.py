"""Aggregations over documents, components, the journal and the master index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Tables, query
from ..functions import cas as C
from ..functions import content as N
from .predicates import _CHECK


@query("agg01_balance", """
WITH x AS (SELECT doc_id, list_max(list_transform(regexp_extract_all(content, '[0-9]+(?:\\.[0-9]+)?', 0), lambda s: CAST(s AS DECIMAL(20, 6)))) AS most FROM component WHERE NOT regexp_matches(lower(content), 'rem|balance|잔량|미기재')),
d AS (SELECT DISTINCT doc_id FROM component), s AS (SELECT doc_id, max(most) AS most, sum(most) AS total FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN 'empty' WHEN most > 100 THEN 'over 100' WHEN total > 110 THEN 'sum over 110' ELSE 'ok' END AS outcome FROM d LEFT JOIN s USING (doc_id)""")
def balance(t: Tables) -> DataFrame:
    """Mass balance: no component above 100, no sum above 110; documents without a stated amount are empty."""
    stated = ~F.lower("content").rlike("rem|balance|잔량|미기재")
    most = F.when(stated, F.array_max(N.numbers(F.col("content"))))
    s = t.component.select("doc_id", stated.alias("stated"), most.alias("most")).groupBy("doc_id").agg(F.bool_or("stated").alias("any"), F.max("most").alias("most"), F.sum("most").alias("total"))
    outcome = F.when(~F.col("any"), "empty").when(F.col("most") > 100, "over 100").when(F.col("total") > N.LIMIT, "sum over 110").otherwise("ok")
    return s.select("doc_id", outcome.alias("outcome"))


@query("agg02_raw_balance", """
WITH r AS (SELECT ord, '<tr><td>' || name || '</td><td>' || cas || '</td><td>' || CAST(ord % 130 AS STRING) || CASE ord % 4 WHEN 0 THEN ' ppm' ELSE ' %' END || '</td></tr>' AS row FROM master),
n AS (SELECT ord, row, regexp_replace(regexp_replace(regexp_replace(row, '<[^>]*>', ' ', 'g'), '[0-9]{2,7}-[0-9]{2}-[0-9]', ' ', 'g'), '\\) [0-9]+', ' ', 'g') AS s FROM r WHERE NOT regexp_matches(lower(row), 'g/mol|mg/m|ppm|twa|stel')),
v AS (SELECT ord % 50 AS doc, list_max(list_filter(list_transform(regexp_extract_all(s, '[0-9]+(?:\\.[0-9]+)?', 0), lambda x: CAST(x AS DECIMAL(20, 6))), lambda x: x <= 100)) AS most FROM n)
SELECT doc, CAST(coalesce(sum(most), 0) AS BIGINT) AS total, coalesce(sum(most), 0) > 110 AS failed FROM v GROUP BY doc""")
def raw_balance(t: Tables) -> DataFrame:
    """The same check on raw table rows: each anchor counts the largest percentage of its own row."""
    unit = F.when(F.col("ord") % 4 == 0, " ppm").otherwise(" %")
    row = F.concat(F.lit("<tr><td>"), "name", F.lit("</td><td>"), "cas", F.lit("</td><td>"), (F.col("ord") % 130).cast("string"), unit, F.lit("</td></tr>"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(row, "<[^>]*>", " "), "[0-9]{2,7}-[0-9]{2}-[0-9]", " "), r"\) [0-9]+", " ")
    most = F.array_max(F.filter(N.numbers(bare), lambda x: x <= 100))
    rows = t.master.where(~F.lower(row).rlike("g/mol|mg/m|ppm|twa|stel")).select((F.col("ord") % 50).alias("doc"), most.alias("most"))
    total = F.coalesce(F.sum("most"), F.lit(0))
    return rows.groupBy("doc").agg(total.cast("long").alias("total"), (total > N.LIMIT).alias("failed"))


def gate_rank(content: Column) -> Column:
    """A range beats a single value, which beats nothing; within a rank the first stays."""
    return F.when(F.contains(content, F.lit("~")), 0).when(~content.isin("", N.MISSING), 1).otherwise(2)


def gate_lock(components: DataFrame) -> DataFrame:
    """One record for each document and number, at the first one's position: a single aggregate, no sort of whole groups."""
    rest = [c for c in components.columns if c not in ("doc_id", "cas", "seq")]
    best = F.min(F.struct(gate_rank(F.col("content")).alias("rank"), "seq", *rest)).alias("x")
    return components.groupBy("doc_id", "cas").agg(best, F.min("seq").alias("position")).select("doc_id", "cas", "position", *(f"x.{c}" for c in rest))


@query("agg03_gate_lock", """
SELECT doc_id, cas, position, content, page, engine FROM (
 SELECT *, min(seq) OVER (PARTITION BY doc_id, cas) AS position, row_number() OVER (PARTITION BY doc_id, cas ORDER BY CASE WHEN contains(content, '~') THEN 0 WHEN content NOT IN ('', '미기재%') THEN 1 ELSE 2 END, seq) AS n FROM component) WHERE n = 1""")
def gate_locked(t: Tables) -> DataFrame:
    return gate_lock(t.component.select("doc_id", "cas", "seq", "content", "page", "engine"))


@query("agg04_run_counters", """
SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'timeout') AS timeouts, count(*) FILTER (WHERE status NOT IN ('timeout', 'failed')) AS completed, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(size) AS BIGINT) AS bytes FROM journal GROUP BY run_id""")
def run_counters(t: Tables) -> DataFrame:
    """An unknown status counts as completed."""
    return t.journal.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.count_if(~F.col("status").isin("timeout", "failed")).alias("completed"), F.sum("cents").alias("cents"), F.sum("size").alias("bytes"),
    )


@query("agg05_ai_metrics", """
SELECT trace_id, count(*) FILTER (WHERE event = 'candidate_created') AS calls, count(*) FILTER (WHERE event = 'candidate_created' AND cents > 5000) AS harvested, count(*) FILTER (WHERE event = 'candidate_created' AND cents <= 5000) AS no_harvest, count(*) FILTER (WHERE event = 'candidate_selected') AS applied FROM journal GROUP BY trace_id""")
def ai_metrics(t: Tables) -> DataFrame:
    call = F.col("event") == "candidate_created"
    return t.journal.groupBy("trace_id").agg(
        F.count_if(call).alias("calls"), F.count_if(call & (F.col("cents") > 5000)).alias("harvested"),
        F.count_if(call & (F.col("cents") <= 5000)).alias("no_harvest"), F.count_if(F.col("event") == "candidate_selected").alias("applied"),
    )


@query("agg06_cas_multiplicity", "SELECT ord, cas, count(*) OVER (PARTITION BY cas) > 1 AS review_required FROM master")
def cas_multiplicity(t: Tables) -> DataFrame:
    return t.master.withColumn("n", F.count("*").over(Window.partitionBy("cas"))).select("ord", "cas", (F.col("n") > 1).alias("review_required"))


@query("agg07_duplicate_ids", "SELECT doc_id, cas, count(*) AS n FROM component GROUP BY doc_id, cas HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    return t.component.groupBy("doc_id", "cas").agg(F.count("*").alias("n")).where("n > 1")


@query("agg08_parents_per_cas", "SELECT cas, count(*) AS parents FROM master WHERE parent AND active AND cas <> '' GROUP BY cas HAVING count(*) > 1")
def parents_per_cas(t: Tables) -> DataFrame:
    """Numbers with several active parents, of which none can be chosen."""
    return t.master.where("parent AND active AND cas <> ''").groupBy("cas").agg(F.count("*").alias("parents")).where("parents > 1")


@query("agg09_manifest", """
SELECT count(*) AS profiles, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE parent) AS parents, count(*) FILTER (WHERE twa = '-') AS without_limit, count(*) FILTER (WHERE decision = '승인') AS approved,
 count(*) FILTER (WHERE decision = '제외') AS excluded, count(*) FILTER (WHERE measured) AS measured, count(DISTINCT cas) AS numbers, count(DISTINCT sort_code) AS codes FROM master""")
def manifest(t: Tables) -> DataFrame:
    n = F.count_if
    return t.master.agg(
        F.count("*").alias("profiles"), n(F.col("active")).alias("active"), n(F.col("parent")).alias("parents"), n(F.col("twa") == "-").alias("without_limit"),
        n(F.col("decision") == "승인").alias("approved"), n(F.col("decision") == "제외").alias("excluded"), n(F.col("measured")).alias("measured"),
        F.count_distinct("cas").alias("numbers"), F.count_distinct("sort_code").alias("codes"),
    )


@query("agg10_mark_merge", "SELECT cas, bool_or(special) AS special, bool_or(permit) AS permit, bool_or(exam) AS exam, bool_or(measured) AS measured FROM master GROUP BY cas")
def mark_merge(t: Tables) -> DataFrame:
    return t.master.groupBy("cas").agg(*(F.bool_or(c).alias(c) for c in ("special", "permit", "exam", "measured")))


def ordered_distinct(df: DataFrame, key: str, value: str, order: str, out: str, separator: str = "; ") -> DataFrame:
    """Distinct values of each key joined in the order of their first occurrence: duplicates go before anything is collected."""
    first = df.groupBy(key, value).agg(F.min(order).alias("first"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value]), separator).alias(out))


@query("agg11_ordered_join", "WITH f AS (SELECT doc_id, content, min(seq) AS first FROM component GROUP BY doc_id, content) SELECT doc_id, string_agg(content, '; ' ORDER BY first, content) AS contents FROM f GROUP BY doc_id")
def ordered_join(t: Tables) -> DataFrame:
    return ordered_distinct(t.component, "doc_id", "content", "seq", "contents")


@query("agg12_plan_groups", """
WITH c AS (SELECT d.process, m.method, m.name, min(c.seq) AS first FROM component c JOIN document d USING (doc_id) JOIN master m ON m.cas = c.cas WHERE m.method <> 'M0' GROUP BY ALL)
SELECT process, method, count(*) AS substances, min(first) AS first FROM c GROUP BY process, method""")
def plan_groups(t: Tables) -> DataFrame:
    rows = t.component.select("doc_id", "cas", "seq").join(t.document.select("doc_id", "process"), "doc_id").join(t.master.where("method <> 'M0'").select("cas", "method", "name"), "cas")
    return rows.groupBy("process", "method", "name").agg(F.min("seq").alias("first")).groupBy("process", "method").agg(F.count("*").alias("substances"), F.min("first").alias("first"))


@query("agg13_median_height", "SELECT doc_id, page, median(height) AS median_height FROM word GROUP BY doc_id, page")
def median_height(t: Tables) -> DataFrame:
    return t.word.groupBy("doc_id", "page").agg(F.median("height").alias("median_height"))


@query("agg14_bbox_union", "SELECT doc_id, page, text, min(x0) AS x0, min(y0) AS y0, max(x0 + width) AS x1, max(y0 + height) AS y1 FROM word GROUP BY doc_id, page, text")
def bbox_union(t: Tables) -> DataFrame:
    right, low = F.max(F.col("x0") + F.col("width")).alias("x1"), F.max(F.col("y0") + F.col("height")).alias("y1")
    return t.word.groupBy("doc_id", "page", "text").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), right, low)


@query("agg15_strictest_limit", "SELECT cas, ord, CAST(twa AS INTEGER) AS twa FROM master WHERE twa <> '-' AND CAST(twa AS INTEGER) > 0 QUALIFY row_number() OVER (PARTITION BY cas ORDER BY CAST(twa AS INTEGER), ord) = 1")
def strictest_limit(t: Tables) -> DataFrame:
    limit = F.col("twa").try_cast("int")
    return t.master.withColumn("twa", limit).where("twa > 0").groupBy("cas").agg(F.min(F.struct("twa", "ord")).alias("x")).select("cas", "x.ord", "x.twa")


_WANTED = "CASE WHEN ord % 2 = 0 THEN TRY_CAST(twa AS DOUBLE) ELSE TRY_CAST(twa AS DOUBLE) * 2 + 0.000001 END"


@query("agg16_unique_limit", f"""
WITH r AS (SELECT ord AS request, cas, {_WANTED} AS wanted FROM master), h AS (SELECT r.request, m.ord FROM r JOIN master m USING (cas) WHERE abs(TRY_CAST(m.twa AS DOUBLE) - r.wanted) < 0.00001 OR abs(TRY_CAST(m.twa AS DOUBLE) * 2 - r.wanted) < 0.00001)
SELECT request, any_value(ord) AS profile FROM h GROUP BY request HAVING count(*) = 1""")
def unique_limit(t: Tables) -> DataFrame:
    """The one profile of a number whose limit is the wanted one, in either unit. (Carrier: the second unit's is twice the first's.)"""
    limits = t.master.select("cas", "ord", F.col("twa").try_cast("double").alias("ppm"), (F.col("twa").try_cast("double") * 2).alias("mg"))
    asked = t.master.selectExpr("cas", "ord AS request", f"{_WANTED} AS wanted")
    hit = (F.abs(F.col("ppm") - F.col("wanted")) < 1e-5) | (F.abs(F.col("mg") - F.col("wanted")) < 1e-5)
    return asked.join(limits, "cas").where(hit).groupBy("request").agg(F.count("*").alias("n"), F.min("ord").alias("profile")).where("n = 1").select("request", "profile")


@query("agg17_method_summary", """
WITH s AS (SELECT event AS method, avg(cents) AS mean_cents, sum(size) AS calls, 100 * avg(CAST(status = 'completed' AS INTEGER)) AS success_rate, bool_and(status <> 'odd' OR seq % 2 = 0) AS pass FROM journal GROUP BY event)
SELECT method, round(mean_cents, 3) AS mean_cents, CAST(calls AS BIGINT) AS calls, round(success_rate, 3) AS success_rate, pass, row_number() OVER (ORDER BY pass DESC, mean_cents, method) = 1 AS recommended FROM s""")
def method_summary(t: Tables) -> DataFrame:
    s = t.journal.groupBy(F.col("event").alias("method")).agg(
        F.avg("cents").alias("mean"), F.sum("size").alias("calls"), (100 * F.avg((F.col("status") == "completed").cast("int"))).alias("rate"),
        F.every((F.col("status") != "odd") | (F.col("seq") % 2 == 0)).alias("pass"),
    )
    best = s.agg(F.min(F.struct((~F.col("pass")).alias("p"), "mean", "method")).alias("best"))
    return s.crossJoin(F.broadcast(best)).select("method", F.round("mean", 3).alias("mean_cents"), "calls", F.round("rate", 3).alias("success_rate"), "pass", (F.col("method") == F.col("best.method")).alias("recommended"))


@query("agg18_page_calls", "SELECT doc_id, array_to_string(list_sort(list(CAST(page AS STRING) || ':' || CAST(n AS STRING) || ':' || CAST(seconds AS STRING))), ',') AS calls, CAST(sum(n) AS BIGINT) AS total FROM (SELECT doc_id, page, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS seconds FROM component GROUP BY doc_id, page) GROUP BY doc_id")
def page_calls(t: Tables) -> DataFrame:
    """Calls and seconds of each page of a document, and all its calls."""
    pages = t.component.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("quantity").alias("seconds"))
    item = F.concat_ws(":", *(F.col(c).cast("string") for c in ("page", "n", "seconds")))
    return pages.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("calls"), F.sum("n").alias("total"))


#: Hundredths of a page that its images cover, each added up and none counted beyond the whole page.
_AREA = "least(100, images * 30 + large_images * 35)"


@query("agg19_text_stats", f"""
SELECT file_hash, round(avg(chars), 6) AS mean_chars, count(*) FILTER (WHERE images > 0) AS image_pages, count(*) FILTER (WHERE {_AREA} >= 55) AS large_pages, CAST(max({_AREA}) AS BIGINT) AS most FROM (SELECT * FROM document QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) <= 3) GROUP BY file_hash""")
def text_stats(t: Tables) -> DataFrame:
    """Over the first three pages of each file: characters, pages with images, and pages of which images cover 55 hundredths."""
    nth = F.row_number().over(Window.partitionBy("file_hash").orderBy("doc_id"))
    first = t.document.withColumn("nth", nth).where("nth <= 3").withColumn("area", F.expr(_AREA))
    return first.groupBy("file_hash").agg(F.round(F.avg("chars"), 6).alias("mean_chars"), F.count_if(F.col("images") > 0).alias("image_pages"), F.count_if(F.col("area") >= 55).alias("large_pages"), F.max("area").alias("most"))


@query("agg20_coverage", f"""
WITH v AS (SELECT doc_id, cas, seq FROM component WHERE {_CHECK}) SELECT doc_id, count(DISTINCT cas) AS stated, count(DISTINCT cas) FILTER (WHERE seq % 5 <> 0) AS extracted, count(DISTINCT cas) = count(DISTINCT cas) FILTER (WHERE seq % 5 <> 0) AS covered FROM v GROUP BY doc_id""")
def coverage(t: Tables) -> DataFrame:
    valid = t.component.where(C.checksum_holds(F.col("cas"))).select("doc_id", "cas", (F.col("seq") % 5 != 0).alias("got")).groupBy("doc_id", "cas").agg(F.bool_or("got").alias("got"))
    counts = valid.groupBy("doc_id").agg(F.count("*").alias("stated"), F.count_if("got").alias("extracted"))
    return counts.withColumn("covered", F.col("stated") == F.col("extracted"))


@query("agg22_first_failure", "SELECT trace_id, event, seq FROM journal WHERE event IN ('failure', 'candidate_rejected') QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY CASE event WHEN 'failure' THEN 0 ELSE 1 END, seq) = 1")
def first_failure(t: Tables) -> DataFrame:
    bad = t.journal.where(F.col("event").isin("failure", "candidate_rejected"))
    first = bad.groupBy("trace_id").agg(F.min(F.struct((F.col("event") != "failure").alias("late"), "seq", "event")).alias("x"))
    return first.select("trace_id", "x.event", "x.seq")


@query("agg23_last_state", "SELECT trace_id, candidate, event, parent, seq FROM journal QUALIFY row_number() OVER (PARTITION BY trace_id, candidate ORDER BY seq DESC) = 1")
def last_state(t: Tables) -> DataFrame:
    return t.journal.groupBy("trace_id", "candidate").agg(F.max(F.struct("seq", "event", "parent")).alias("x")).select("trace_id", "candidate", "x.event", "x.parent", "x.seq")
