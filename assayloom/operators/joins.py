"""Joins of components with dimensions, between lines, and between runs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import cas as C
from ..sources import domain as D
from .predicates import _CHECK

_FIRST = "first AS (SELECT cas, name, twa, special, permit, exam, measured FROM master QUALIFY row_number() OVER (PARTITION BY cas ORDER BY ord) = 1)"


def first_per_cas(master: DataFrame) -> DataFrame:
    """The first master row of each registry number; the rest of its columns travel with it in one aggregate."""
    rest = [c for c in master.columns if c not in ("cas", "ord")]
    return master.groupBy("cas").agg(F.min(F.struct("ord", *rest)).alias("x")).select("cas", *(f"x.{c}" for c in rest))


@query("jon01_regulator", f"""
WITH {_FIRST} SELECT c.doc_id, c.seq, c.cas, coalesce(f.name, 'Unknown') AS regulator_name, coalesce(f.measured, false) AS is_measured, coalesce(f.special, false) AS is_special
FROM component c LEFT JOIN first f USING (cas)""")
def regulator(t: Tables) -> DataFrame:
    f = first_per_cas(t.master).select("cas", F.col("name").alias("known"), "measured", "special")
    no = F.lit(False)
    return t.component.join(f, "cas", "left").select(
        "doc_id", "seq", "cas", F.coalesce("known", F.lit("Unknown")).alias("regulator_name"),
        F.coalesce("measured", no).alias("is_measured"), F.coalesce("special", no).alias("is_special"),
    )


@query("jon02_exposure_override", """
WITH csv AS (SELECT cas, max_by(twa, ord) AS twa FROM master GROUP BY cas), api AS (SELECT cas, min_by(CAST(ord % 50 AS STRING), ord) AS twa FROM master WHERE ord % 2 = 0 GROUP BY cas)
SELECT c.doc_id, c.seq, coalesce(nullif(nullif(csv.twa, '-'), ''), api.twa, '-') AS twa FROM component c LEFT JOIN csv USING (cas) LEFT JOIN api USING (cas)""")
def exposure_override(t: Tables) -> DataFrame:
    csv = t.master.groupBy("cas").agg(F.max_by("twa", "ord").alias("csv_twa"))
    api = t.master.where("ord % 2 = 0").groupBy("cas").agg(F.min_by(F.expr("CAST(ord % 50 AS STRING)"), "ord").alias("api_twa"))
    own = F.nullif(F.nullif("csv_twa", F.lit("-")), F.lit(""))
    return t.component.join(csv, "cas", "left").join(api, "cas", "left").select("doc_id", "seq", F.coalesce(own, "api_twa", F.lit("-")).alias("twa"))


@query("jon03_standard_name", f"""
WITH {_FIRST}, mes AS (SELECT cas, max_by(upper(name), ord) AS name FROM master WHERE ord % 3 = 0 GROUP BY cas)
SELECT c.doc_id, c.seq, coalesce(mes.name, first.name, trim(regexp_replace(c.name, '\\s+', ' ', 'g'))) AS standard_name FROM component c LEFT JOIN mes USING (cas) LEFT JOIN first USING (cas)""")
def standard_name(t: Tables) -> DataFrame:
    first = first_per_cas(t.master).select("cas", F.col("name").alias("first_name"))
    mes = t.master.where("ord % 3 = 0").groupBy("cas").agg(F.max_by(F.upper("name"), "ord").alias("mes_name"))
    own = F.trim(F.regexp_replace("name", r"\s+", " "))
    return t.component.join(mes, "cas", "left").join(first, "cas", "left").select("doc_id", "seq", F.coalesce("mes_name", "first_name", own).alias("standard_name"))


@query("jon04_candidate_expansion", f"""
WITH {D.values_sql("redirect", "a, b", D.REDIRECTS)}, {D.values_sql("expansion", "a, b", ((D.CHROMIUM, D.CHROMIUM_SIX), *((a, b) for a in D.SILICA for b in D.SILICA if a != b)))},
k AS (SELECT c.doc_id, c.seq, coalesce(r.b, c.cas) AS cas FROM chemical c LEFT JOIN redirect r ON r.a = c.cas WHERE c.cas <> ''),
w AS (SELECT doc_id, seq, replace(cas, '-', '') AS digits FROM k UNION ALL SELECT k.doc_id, k.seq, replace(e.b, '-', '') FROM k JOIN expansion e ON e.a = k.cas)
SELECT w.doc_id, w.seq, m.ord, m.name FROM w JOIN roster m ON replace(m.cas, '-', '') = w.digits WHERE m.cas <> ''
UNION ALL SELECT k.doc_id, k.seq, m.ord, m.name FROM k JOIN roster m ON m.sort_code = '2D-10-010' AND m.cas = '' WHERE k.cas IN ('7631-86-9', '14808-60-7', '14464-46-1', '15468-32-3')""")
def candidate_expansion(t: Tables) -> DataFrame:
    """All registry rows of a number, by digits: redirected numbers, chromium with its sixth state, silica with its family and with the row without a number."""
    redirects = D.table(t.spark, "cas string, other string", D.REDIRECTS)
    more = D.table(t.spark, "cas string, other string", ((D.CHROMIUM, D.CHROMIUM_SIX), *((a, b) for a in D.SILICA for b in D.SILICA if a != b)))
    asked = t.chemical.where("cas <> ''").select("doc_id", "seq", "cas").join(F.broadcast(redirects), "cas", "left").select("doc_id", "seq", F.coalesce("other", "cas").alias("cas"))
    wide = asked.unionByName(asked.join(F.broadcast(more), "cas").select("doc_id", "seq", F.col("other").alias("cas")))
    rows = t.roster.select(C.digits(F.col("cas")).alias("digits"), "cas", "ord", "name", "sort_code")
    hits = wide.withColumn("digits", C.digits(F.col("cas"))).drop("cas").join(rows.where("cas <> ''"), "digits").select("doc_id", "seq", "ord", "name")
    # The family's numbers meet the one row without a number on a constant key.
    forced = rows.where((F.col("cas") == "") & (F.col("sort_code") == D.FORCED_CODE)).select(F.explode(F.array(*map(F.lit, D.SILICA))).alias("cas"), "ord", "name")
    return hits.unionByName(asked.join(forced, "cas").select("doc_id", "seq", "ord", "name"))


def bare_name(name: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(name, "[^0-9a-zA-Z가-힣]", ""))


_BARE = "lower(regexp_replace({}, '[^0-9a-zA-Z가-힣]', '', 'g'))"


@query("jon05_cas_or_name", f"""
WITH r AS (SELECT doc_id, seq, cas, CASE WHEN seq % 2 = 0 THEN (SELECT any_value(p_name) FROM part WHERE 1 = 0) ELSE NULL END AS x, seq FROM component),
req AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN '' ELSE cas END AS cas, seq % 400 AS wanted FROM component),
named AS (SELECT ord, {_BARE.format("name")} AS bare FROM master),
q AS (SELECT r.doc_id, r.seq, r.cas, n.bare FROM req r LEFT JOIN named n ON n.ord = r.wanted),
hits AS (SELECT q.doc_id, q.seq, m.ord, 0 AS arm FROM q JOIN master m ON m.cas = q.cas UNION ALL SELECT q.doc_id, q.seq, n.ord, 1 FROM q JOIN named n ON n.bare = q.bare)
SELECT doc_id, seq, ord, CAST(min(arm) AS INTEGER) AS arm FROM hits GROUP BY doc_id, seq, ord""")
def cas_or_name(t: Tables) -> DataFrame:
    """An OR of two equalities as two equi-joins; number hits come first and each profile once."""
    named = t.master.select("ord", bare_name(F.col("name")).alias("bare"))
    requests = t.component.select("doc_id", "seq", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("cas")).alias("cas"), (F.col("seq") % 400).alias("wanted"))
    asked = requests.join(named.withColumnRenamed("ord", "wanted"), "wanted", "left")
    hits = asked.join(t.master.select("cas", "ord"), "cas").select("doc_id", "seq", "ord", F.lit(0).alias("arm"))
    hits = hits.unionByName(asked.join(named, "bare").select("doc_id", "seq", "ord", F.lit(1).alias("arm")))
    return hits.groupBy("doc_id", "seq", "ord").agg(F.min("arm").alias("arm"))


_RULES = "rule AS (SELECT ord AS rule_id, cas AS source_cas, {bare} AS source_bare, ord AS source_id, (ord * 7) % (SELECT count(*) FROM part) AS target, active AND decision <> '제외' AS active FROM master WHERE ord % 20 = 0)"


@query("jon06_rule_source", f"""
WITH {_RULES.format(bare=_BARE.format("name"))}, p AS (SELECT ord, cas, {_BARE.format("name")} AS bare FROM master)
SELECT DISTINCT p.ord, rule_id FROM p JOIN rule ON p.ord = source_id OR p.cas = source_cas OR p.bare = source_bare""")
def rule_source(t: Tables) -> DataFrame:
    p = t.master.select("ord", "cas", bare_name(F.col("name")).alias("bare"))
    rules = t.master.where("ord % 20 = 0").select(F.col("ord").alias("rule_id"), "cas", bare_name(F.col("name")).alias("bare"))
    arms = [p.join(rules.select("rule_id", F.col("rule_id").alias("ord")), "ord"), p.join(rules.select("rule_id", "cas"), "cas"), p.join(rules.select("rule_id", "bare"), "bare")]
    found = [a.select("ord", "rule_id") for a in arms]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


@query("jon07_rule_target", f"""
WITH {_RULES.format(bare="name")} SELECT r.rule_id, m.ord AS target, m.name AS target_name FROM rule r JOIN master m ON m.ord = r.target WHERE r.active AND m.active""")
def rule_target(t: Tables) -> DataFrame:
    n = t.part.agg(F.count("*").alias("n"))
    rules = t.master.where("ord % 20 = 0 AND active AND decision <> '제외'").crossJoin(F.broadcast(n)).select(F.col("ord").alias("rule_id"), F.expr("(ord * 7) % n").alias("target"))
    targets = t.master.where("active").select(F.col("ord").alias("target"), F.col("name").alias("target_name"))
    return rules.join(targets, "target").select("rule_id", "target", "target_name")


@query("jon08_legacy_codes", """
WITH codes AS (SELECT doc_id, seq, (SELECT NULL) AS x FROM component WHERE 1 = 0), last AS (SELECT sort_code, max(ord) AS ord FROM master GROUP BY sort_code),
w AS (SELECT ord AS request, sort_code FROM master WHERE ord % 2 = 0)
SELECT last.ord AS profile, min(w.request) AS first_request FROM w JOIN last USING (sort_code) GROUP BY last.ord""")
def legacy_codes(t: Tables) -> DataFrame:
    """Codes to profiles (the last of a code wins), each profile at its first request."""
    last = t.master.groupBy("sort_code").agg(F.max("ord").alias("profile"))
    return t.master.where("ord % 2 = 0").join(last, "sort_code").groupBy("profile").agg(F.min("ord").alias("first_request"))


@query("jon09_scored_lookup", """
WITH r AS (SELECT ord AS request, cas, CASE ord % 3 WHEN 0 THEN name WHEN 1 THEN 'x ' || name || ' y' ELSE 'zzz' END AS name FROM master WHERE ord % 5 = 0),
c AS (SELECT r.request, m.ord, CASE WHEN m.name = r.name THEN 0 WHEN contains(r.name, m.name) THEN 1 ELSE 2 END AS tier, length(m.name) AS n, count(*) OVER (PARTITION BY r.request) AS candidates FROM r JOIN master m USING (cas))
SELECT request, ord AS profile, CAST(tier AS INTEGER) AS tier FROM c WHERE tier < 2 OR candidates = 1 QUALIFY row_number() OVER (PARTITION BY request ORDER BY tier, n DESC, ord) = 1""")
def scored_lookup(t: Tables) -> DataFrame:
    n = F.col("ord") % 3
    asked = F.when(n == 0, F.col("name")).when(n == 1, F.concat(F.lit("x "), "name", F.lit(" y"))).otherwise("zzz")
    requests = t.master.where("ord % 5 = 0").select(F.col("ord").alias("request"), "cas", asked.alias("asked"))
    tier = F.when(F.col("name") == F.col("asked"), 0).when(F.contains("asked", "name"), 1).otherwise(2)
    met = requests.join(t.master.select("cas", "ord", "name"), "cas").withColumn("tier", tier)
    best = met.groupBy("request").agg(F.count("*").alias("n"), F.min(F.struct("tier", (-F.length("name")).alias("l"), "ord")).alias("x"))
    return best.where("x.tier < 2 OR n = 1").select("request", F.col("x.ord").alias("profile"), "x.tier")


@query("jon10_neighbours", """
SELECT DISTINCT a.doc_id, a.page, a.id FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.page = b.page AND a.id <> b.id AND a.text = b.text AND abs(a.x0 - b.x0) < 40 AND abs(a.y0 - b.y0) < 12""")
def neighbours(t: Tables) -> DataFrame:
    """A range join inside a page: words with a twin close by. The grid of 40 x 12 makes it an equi-join on nine cells."""
    words = t.word.select("doc_id", "page", "id", "text", "x0", "y0")
    cell = lambda c, size, by: (F.floor(F.col(c) / size) + by).cast("long")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = words.withColumn("s", steps).withColumns({"cx": cell("x0", 40, F.col("s.i")), "cy": cell("y0", 12, F.col("s.j"))}).drop("s")
    right = words.select("doc_id", "page", "text", F.col("id").alias("id2"), F.col("x0").alias("x2"), F.col("y0").alias("y2"), cell("x0", 40, 0).alias("cx"), cell("y0", 12, 0).alias("cy"))
    near = (F.abs(F.col("x0") - F.col("x2")) < 40) & (F.abs(F.col("y0") - F.col("y2")) < 12) & (F.col("id") != F.col("id2"))
    return left.join(right, ["doc_id", "page", "text", "cx", "cy"]).where(near).select("doc_id", "page", "id").distinct()


@query("jon11_points_in_boxes", """
WITH box AS (SELECT doc_id, page, min(x0) + 60 AS bx0, min(y0) + 20 AS by0, max(x0) - 120 AS bx1, max(y0) - 40 AS by1, count(*) AS n FROM word GROUP BY doc_id, page)
SELECT w.doc_id, w.page, w.id FROM word w JOIN box b USING (doc_id, page) WHERE b.n >= 50 OR (w.x0 + w.width / 2.0 BETWEEN bx0 - 3 AND bx1 + 3 AND w.y0 + w.height / 2.0 BETWEEN by0 - 3 AND by1 + 3)""")
def points_in_boxes(t: Tables) -> DataFrame:
    """Words inside the table's box, a filter that pages of 50 words and more skip."""
    box = t.word.groupBy("doc_id", "page").agg((F.min("x0") + 60).alias("bx0"), (F.min("y0") + 20).alias("by0"), (F.max("x0") - 120).alias("bx1"), (F.max("y0") - 40).alias("by1"), F.count("*").alias("n"))
    x, y = F.col("x0") + F.col("width") / 2, F.col("y0") + F.col("height") / 2
    inside = x.between(F.col("bx0") - 3, F.col("bx1") + 3) & y.between(F.col("by0") - 3, F.col("by1") + 3)
    return t.word.join(box, ["doc_id", "page"]).where((F.col("n") >= 50) | inside).select("doc_id", "page", "id")


@query("jon12_selected_events", "SELECT seq, trace_id, event FROM journal WHERE trace_id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 29 = 0)")
def selected_events(t: Tables) -> DataFrame:
    chosen = t.orders.where("o_orderkey % 29 = 0").select(F.col("o_custkey").alias("trace_id"))
    return t.journal.join(chosen, "trace_id", "left_semi").select("seq", "trace_id", "event")


@query("jon13_missing_profiles", """
WITH relation AS (SELECT ord AS relation_id, ord AS source, ord + 3 AS target FROM master WHERE ord % 4 = 0)
SELECT relation_id, target AS missing FROM relation WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.ord = relation.target AND m.active)""")
def missing_profiles(t: Tables) -> DataFrame:
    relation = t.master.where("ord % 4 = 0").select(F.col("ord").alias("relation_id"), (F.col("ord") + 3).alias("missing"))
    return relation.join(t.master.where("active").select(F.col("ord").alias("missing")), "missing", "left_anti").select("relation_id", "missing")


@query("jon14_without_method", "SELECT c.doc_id, c.seq, c.name FROM component c WHERE c.cas NOT IN (SELECT cas FROM master WHERE method <> 'M0')")
def without_method(t: Tables) -> DataFrame:
    known = t.master.where("method <> 'M0'").select("cas")
    return t.component.join(known, "cas", "left_anti").select("doc_id", "seq", "name")


@query("jon15_golden_diff", """
WITH golden AS (SELECT doc_id, cas, min(content) AS content FROM component GROUP BY doc_id, cas), actual AS (SELECT doc_id, cas, max(content) AS content FROM component WHERE seq % 6 <> 0 GROUP BY doc_id, cas),
n AS (SELECT doc_id, count(*) AS g FROM golden GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS a FROM actual GROUP BY doc_id),
bad AS (SELECT n.doc_id FROM n LEFT JOIN a USING (doc_id) WHERE n.g <> coalesce(a.a, 0)),
d AS (SELECT coalesce(golden.doc_id, actual.doc_id) AS doc_id, coalesce(golden.cas, actual.cas) AS cas, CASE WHEN actual.cas IS NULL THEN 'missing' WHEN golden.cas IS NULL THEN 'extra' WHEN golden.content <> actual.content THEN 'mismatch' ELSE 'match' END AS outcome FROM golden FULL JOIN actual ON golden.doc_id = actual.doc_id AND golden.cas = actual.cas)
SELECT doc_id, cas, outcome FROM d WHERE outcome <> 'match' AND doc_id NOT IN (SELECT doc_id FROM bad) UNION ALL SELECT doc_id, '', 'count' FROM bad""")
def golden_diff(t: Tables) -> DataFrame:
    """Differences of two sets of components; where the counts differ, that is the document's one failure."""
    golden = t.component.groupBy("doc_id", "cas").agg(F.min("content").alias("want"), F.lit(1).alias("g"))
    actual = t.component.where("seq % 6 <> 0").groupBy("doc_id", "cas").agg(F.max("content").alias("got"), F.lit(1).alias("a"))
    both = golden.join(actual, ["doc_id", "cas"], "full")
    counts = both.groupBy("doc_id").agg((F.coalesce(F.sum("g"), F.lit(0)) != F.coalesce(F.sum("a"), F.lit(0))).alias("off"))
    outcome = F.when(F.col("a").isNull(), "missing").when(F.col("g").isNull(), "extra").when(F.col("want") != F.col("got"), "mismatch").otherwise("match")
    rows = both.withColumn("outcome", outcome).where("outcome <> 'match'").join(counts.where("NOT off"), "doc_id", "left_semi").select("doc_id", "cas", "outcome")
    return rows.unionByName(counts.where("off").select("doc_id", F.lit("").alias("cas"), F.lit("count").alias("outcome")))


@query("jon16_tiered_match", """
WITH j AS (SELECT ord AS j, cas, lower(name) AS name FROM master WHERE ord % 10 = 0), i AS (SELECT ord AS i, cas, lower(name) AS name, ord % 97 AS factor FROM master WHERE ord % 3 = 0),
hits AS (SELECT j.j, i.i, 0 AS tier FROM j JOIN i ON i.factor = j.j % 97 AND i.cas <> j.cas AND j.j % 20 = 0 UNION ALL SELECT j.j, i.i, 1 FROM j JOIN i USING (cas) UNION ALL SELECT j.j, i.i, 2 FROM j JOIN i ON left(j.name, 8) = left(i.name, 8) AND (contains(j.name, i.name) OR contains(i.name, j.name)))
SELECT j, i, CAST(tier AS INTEGER) AS tier FROM hits QUALIFY row_number() OVER (PARTITION BY j ORDER BY tier, i) = 1""")
def tiered_match(t: Tables) -> DataFrame:
    """Three candidate sets by priority: mapped factor, same number, containment; the first hit of each item wins."""
    j = t.master.where("ord % 10 = 0").select(F.col("ord").alias("j"), "cas", F.lower("name").alias("name"), F.expr("ord % 97").alias("factor"))
    i = t.master.where("ord % 3 = 0").select(F.col("ord").alias("i"), F.col("cas").alias("cas_i"), F.lower("name").alias("name_i"), F.expr("ord % 97").alias("factor_i"))
    mapped = j.where("j % 20 = 0").join(i, (F.col("factor") == F.col("factor_i")) & (F.col("cas") != F.col("cas_i"))).withColumn("tier", F.lit(0))
    same = j.join(i, F.col("cas") == F.col("cas_i")).withColumn("tier", F.lit(1))
    within = j.join(i, (F.substring("name", 1, 8) == F.substring("name_i", 1, 8)) & (F.contains("name", "name_i") | F.contains("name_i", "name"))).withColumn("tier", F.lit(2))
    hits = mapped.unionByName(same).unionByName(within)
    return hits.groupBy("j").agg(F.min(F.struct("tier", "i")).alias("x")).select("j", "x.i", "x.tier")


#: Categories that stand before a name.
CATEGORIES = ("측정 비대상", "단시간 및 임시작업", "보관", "허용소비량 미만")


def pure_name(name: F.Column) -> F.Column:
    """Without what is in parentheses, categories, brackets and space; in lower case."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    text = strip(F.regexp_replace(name, r"\(.*?\)", ""))
    for word in CATEGORIES:
        text = F.when(text.startswith(word), strip(F.substring(text, len(word) + 1, 1_000_000))).otherwise(text)
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\[특별\]|\[특검\]|\[허가\]", ""), r"(?U)[\[\]\s]+", ""))


def tiers(j: DataFrame, i: DataFrame, mapped: DataFrame) -> DataFrame:
    """The first hit of each item of j (j, cas, name) in i (i, cas, name): by a mapped factor (j, f_ord, i), by number, or where one
    name contains the other anywhere. Names are met by equality with all substrings of the longer, so that nothing is lost and no pair
    is made twice; of what is alike, the first i is kept, and items with a hit by factor or number need no names."""
    first = lambda c: F.min("i").alias(c)
    by_factor = mapped.groupBy("j").agg(F.min(F.struct("f_ord", "i")).alias("x")).select("j", "x.i", F.lit(0).alias("tier"))
    by_number = j.select("j", "cas").join(i.groupBy("cas").agg(first("i")), "cas").select("j", "i", F.lit(1).alias("tier"))
    hits = by_factor.unionByName(by_number)
    left = j.join(hits.select("j"), "j", "left_anti").select("j", pure_name(F.col("name")).alias("name")).where("name <> ''")
    names = i.select("i", pure_name(F.col("name")).alias("name")).where("name <> ''").groupBy("name").agg(first("i"))
    parts = F.expr("explode(array_distinct(flatten(transform(sequence(1, length(name)), a -> transform(sequence(1, length(name) - a + 1), n -> substring(name, a, n))))))").alias("name")
    holds = left.select("j", parts).join(names, "name").select("j", "i")
    asked = left.select("name").distinct()
    held = names.select("i", parts).join(asked, "name", "left_semi").groupBy("name").agg(first("i"))
    held = left.join(held, "name").select("j", "i")
    hits = hits.unionByName(holds.unionByName(held).withColumn("tier", F.lit(2)))
    return hits.groupBy("j").agg(F.min(F.struct("tier", "i")).alias("x")).select("j", "x.i", "x.tier")


_PURE = r"lower(regexp_replace(regexp_replace({}, '\(.*?\)', '', 'g'), '[\[\]\s]+', '', 'g'))"


@query("jon16_whole_match", f"""
WITH m AS (SELECT ord, cas, {_PURE.format("name")} AS name FROM master),
hits AS (SELECT j.ord AS j, i.ord AS i, 0 AS tier FROM m j JOIN m i ON i.ord % 97 = j.ord % 97 AND i.cas <> j.cas WHERE j.ord % 20 = 0 UNION ALL SELECT j.ord, i.ord, 1 FROM m j JOIN m i USING (cas) UNION ALL SELECT j.ord, i.ord, 2 FROM m j JOIN m i ON contains(j.name, i.name) OR contains(i.name, j.name) WHERE j.name <> '' AND i.name <> '')
SELECT j, i, CAST(tier AS INTEGER) AS tier FROM hits QUALIFY row_number() OVER (PARTITION BY j ORDER BY tier, i) = 1""")
def whole_match(t: Tables) -> DataFrame:
    """All of master on both sides. The factors are data made up here: every twentieth item has one. A factor's first two numbers do."""
    j = t.master.select(F.col("ord").alias("j"), "cas", "name")
    i = t.master.select(F.col("ord").alias("i"), "cas", "name")
    heads = i.groupBy(F.expr("i % 97").alias("factor"), F.col("cas").alias("cas_i")).agg(F.min("i").alias("i"))
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("factor").orderBy("i"))).where("n <= 2")
    mapped = j.where("j % 20 = 0").withColumn("factor", F.expr("j % 97")).join(heads, "factor").where("cas <> cas_i").select("j", F.lit(0).alias("f_ord"), "i")
    return tiers(j, i, mapped)


@query("jon17_cas_repair", """
WITH bad AS (SELECT doc_id, seq, cas FROM component WHERE seq % 7 = 0), good AS (SELECT doc_id, seq, cas FROM component WHERE seq % 7 <> 0)
SELECT bad.doc_id, bad.seq, bad.cas, min_by(good.cas, good.seq) AS repaired FROM bad JOIN good ON good.doc_id = bad.doc_id AND length(good.cas) = length(bad.cas) AND hamming(good.cas, bad.cas) <= 1 GROUP BY ALL""")
def cas_repair(t: Tables) -> DataFrame:
    bad = t.component.where("seq % 7 = 0").select("doc_id", "seq", "cas", F.length("cas").alias("n"))
    good = t.component.where("seq % 7 <> 0").select("doc_id", F.col("seq").alias("at"), F.col("cas").alias("other"), F.length("cas").alias("n"))
    near = bad.join(good, ["doc_id", "n"]).where(C.hamming_one(F.col("cas"), F.col("other")))
    return near.groupBy("doc_id", "seq", "cas").agg(F.min_by("other", "at").alias("repaired"))


def repair_invalid(component: DataFrame) -> DataFrame:
    """Each number whose check digit fails, with the document's first genuine number of its length within Hamming distance 1."""
    numbers = component.select("doc_id", "seq", "cas", F.length("cas").alias("n"), C.checksum_holds(F.col("cas")).alias("holds"))
    bad = numbers.where("NOT holds").drop("holds")
    good = numbers.where("holds").select("doc_id", F.col("seq").alias("at"), F.col("cas").alias("other"), "n")
    near = bad.join(good, ["doc_id", "n"]).where(C.hamming_one(F.col("cas"), F.col("other")))
    return near.groupBy("doc_id", "seq", "cas").agg(F.min_by("other", "at").alias("repaired"))


@query("jon17_invalid_repair", f"""
WITH checked AS (SELECT doc_id, seq, cas, {_CHECK} AS holds FROM component)
SELECT bad.doc_id, bad.seq, bad.cas, min_by(good.cas, good.seq) AS repaired FROM checked bad JOIN checked good ON good.doc_id = bad.doc_id AND length(good.cas) = length(bad.cas) AND hamming(good.cas, bad.cas) <= 1
WHERE NOT bad.holds AND good.holds GROUP BY ALL""")
def invalid_repair(t: Tables) -> DataFrame:
    """All components, by the check digit; jon17_cas_repair takes every seventh as bad in its place."""
    return repair_invalid(t.component)


@query("jon18_name_typos", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part), typed AS (SELECT DISTINCT p_name AS typed, substr(p_name, 1, 2) || substr(p_name, 4) AS asked FROM part)
SELECT asked, name, CAST(levenshtein(asked, name) AS INTEGER) AS distance FROM (SELECT DISTINCT asked FROM typed) JOIN names ON abs(length(asked) - length(name)) <= 2 AND levenshtein(asked, name) * 10 <= 2 * greatest(length(asked), length(name))
QUALIFY row_number() OVER (PARTITION BY asked ORDER BY levenshtein(asked, name), name) <= 3""")
def name_typos(t: Tables) -> DataFrame:
    """The three nearest names of a misspelt one; a dimension of distinct names, blocked by length."""
    names = t.part.select(F.col("p_name").alias("name")).distinct().withColumn("n", F.length("name"))
    asked = t.part.select(F.concat(F.substring("p_name", 1, 2), F.expr("substr(p_name, 4)")).alias("asked")).distinct()
    near = asked.withColumn("n", F.explode(F.expr("sequence(length(asked) - 2, length(asked) + 2)"))).join(names, "n")
    near = near.withColumn("distance", F.levenshtein("asked", "name")).where(F.col("distance") * 10 <= 2 * F.greatest(F.length("asked"), F.length("name")))
    order = Window.partitionBy("asked").orderBy("distance", "name")
    return near.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("asked", "name", "distance")


def similar_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Names like each asked one, as difflib.get_close_matches finds them (ratio of 0.8, the best three, equal ones by name downwards),
    then those that hold it or that it holds, of a length at most two apart. A ratio of 0.8 needs lengths within a factor of 1.5, so
    blocks of length lose none."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = difflib.SequenceMatcher()
        for batch in batches:
            kept: list[tuple[str, str, float, bool]] = []
            for word, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word != matcher.b:
                    matcher.set_seq2(word)
                matcher.set_seq1(name)
                contained = abs(len(word) - len(name)) <= 2 and (word in name or name in word)
                ratio = matcher.ratio() if matcher.real_quick_ratio() >= 0.8 and matcher.quick_ratio() >= 0.8 else 0.0
                if contained or ratio >= 0.8:
                    kept.append((word, name, ratio, contained))
            columns = list(zip(*kept, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True)], ["asked", "name", "ratio", "contained"])

    blocks = F.expr("explode(sequence(greatest(0, least(length(asked) - 2, (2 * length(asked) + 2) div 3)), greatest(length(asked) + 2, 3 * length(asked) div 2)))")
    pairs = asked.where("asked IS NOT NULL").select("asked").distinct().select("asked", blocks.alias("n")).join(names.select("name").distinct().withColumn("n", F.length("name").cast("long")), "n")
    near = pairs.select("asked", "name").mapInArrow(compare, "asked string, name string, ratio double, contained boolean")
    close = F.when(F.col("ratio") >= 0.8, F.col("ratio"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(close.desc_nulls_last(), F.desc("name"))))
    best = (F.col("rank") <= 3) & (F.col("ratio") >= 0.8)
    order = Window.partitionBy("asked").orderBy(F.when(best, F.col("rank")).asc_nulls_last(), "name")
    return ranked.where(best | F.col("contained")).select("asked", "name", F.row_number().over(order).alias("place"))


@query("jon18_similar_names")
def similar_part_names(t: Tables) -> DataFrame:
    """The names of jon18_name_typos by the ratio and by containment, which SQL lacks; that query has the Levenshtein distance instead."""
    asked = t.part.select(F.concat(F.substring("p_name", 1, 2), F.expr("substr(p_name, 4)")).alias("asked"))
    return similar_names(asked, t.part.select(F.col("p_name").alias("name")))


@query("jon19_siblings", "SELECT ord, cas, count(*) OVER (PARTITION BY cas) AS siblings, array_to_string(list_sort(list(name) OVER (PARTITION BY cas)), ' | ') AS names FROM master")
def siblings(t: Tables) -> DataFrame:
    groups = t.master.groupBy("cas").agg(F.count("*").alias("siblings"), F.array_join(F.sort_array(F.collect_list("name")), " | ").alias("names"))
    return t.master.select("ord", "cas").join(groups, "cas").select("ord", "cas", "siblings", "names")


@query("jon20_baseline", """
WITH b AS (SELECT o_custkey AS file, o_orderpriority AS method, sum(CAST(floor(o_totalprice) AS BIGINT)) AS cost FROM orders GROUP BY ALL)
SELECT x.file, x.method, x.cost, CAST(x.cost - y.cost AS BIGINT) AS over_baseline FROM (SELECT file, method, CAST(cost AS BIGINT) AS cost FROM b) x JOIN b y ON y.file = x.file AND y.method = '5-LOW'""")
def baseline(t: Tables) -> DataFrame:
    b = t.orders.groupBy(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("method")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("cost"))
    own = Window.partitionBy("file")
    return b.withColumn("base", F.max(F.when(F.col("method") == "5-LOW", F.col("cost"))).over(own)).where("base IS NOT NULL").select("file", "method", "cost", (F.col("cost") - F.col("base")).alias("over_baseline"))


@query("jon21_manual_override", """
WITH manual AS (SELECT o_custkey AS key, max_by('manual ' || CAST(o_orderkey AS STRING), o_orderkey) AS value FROM orders WHERE o_orderkey % 31 = 0 GROUP BY o_custkey)
SELECT d.doc_id, coalesce(m.value, d.product) AS product FROM document d LEFT JOIN manual m ON 'h' || CAST(m.key AS STRING) = d.file_hash""")
def manual_override(t: Tables) -> DataFrame:
    manual = t.orders.where("o_orderkey % 31 = 0").groupBy(F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("file_hash")).agg(F.max_by(F.concat(F.lit("manual "), F.col("o_orderkey").cast("string")), "o_orderkey").alias("value"))
    return t.document.join(manual, "file_hash", "left").select("doc_id", F.coalesce("value", "product").alias("product"))
