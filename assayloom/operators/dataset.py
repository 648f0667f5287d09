"""The reviewed index of substances: profiles, relations, rules, their validator and the resolver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..sources import domain as D
from ..functions import cas as C
from .scalars import sort_code_parts

#: The carriers of relations and rules, in both dialects.
_RELATION = "ord AS relation_id, ord AS source, CASE WHEN ord % 40 = 0 THEN ord ELSE ord + 3 END AS target, active, CASE WHEN decision = '보류' THEN 'REVIEW' ELSE 'APPROVED' END AS review_status"
_RULE = "ord AS rule_id, ord AS source, ord + 6 AS target, cas AS source_cas, active AND decision <> '보류' AS active, decision, mark IN ('Y', '1') AS needs_confirmation, mark = '' AS auto_confirmed"
_TABLES = f"relation AS (SELECT {_RELATION} FROM master WHERE ord % 8 = 0), rule AS (SELECT {_RULE} FROM master WHERE ord % 15 = 0), profile AS (SELECT ord, cas, name, active, parent, decision, CASE WHEN ord % 31 = 0 THEN ord - 1 WHEN ord % 9 = 0 THEN ord + 90000000 END AS parent_id, CASE WHEN ord % 50 = 0 THEN replace(cas, '-', '') WHEN ord % 60 = 7 THEN NULL ELSE cas END AS runtime_cas FROM master)"


def relations(t: Tables) -> DataFrame:
    return t.master.where("ord % 8 = 0").selectExpr(*(_split(_RELATION)))


def rules(t: Tables) -> DataFrame:
    return t.master.where("ord % 15 = 0").selectExpr(*(_split(_RULE)))


def profiles(t: Tables) -> DataFrame:
    parent = F.when(F.col("ord") % 31 == 0, F.col("ord") - 1).when(F.col("ord") % 9 == 0, F.col("ord") + 90_000_000)
    runtime = F.when(F.col("ord") % 50 == 0, C.digits(F.col("cas"))).when(F.col("ord") % 60 == 7, None).otherwise(F.col("cas"))
    return t.master.select("ord", "cas", "name", "active", "parent", "decision", parent.alias("parent_id"), runtime.alias("runtime_cas"))


def _split(columns: str) -> list[str]:
    """Top-level commas only."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


@query("etl01_profiles", """
SELECT ord, cas, name, CAST(substr(sort_code, 1, 1) AS INTEGER) AS category_order, substr(sort_code, 1, 5) AS sort_group, decision IN ('승인', '수정', '추가검토') AS is_active, decision IN ('승인', '수정') AS selectable, count(*) OVER (PARTITION BY cas) > 1 AS review_required FROM master""")
def build_profiles(t: Tables) -> DataFrame:
    parts = sort_code_parts(F.col("sort_code"))
    several = t.master.groupBy("cas").agg((F.count("*") > 1).alias("review_required"))
    return t.master.join(several, "cas").select(
        "ord", "cas", "name", parts["category_order"].alias("category_order"), parts["sort_group"].alias("sort_group"),
        F.col("decision").isin("승인", "수정", "추가검토").alias("is_active"), F.col("decision").isin("승인", "수정").alias("selectable"), "review_required",
    )


@query("etl02_supplements", "SELECT DISTINCT cas FROM component c WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.cas = c.cas)")
def supplements(t: Tables) -> DataFrame:
    """Sources that no profile resolves become profiles of their own; one that is added resolves the next of its number, so each comes once."""
    return t.component.select("cas").distinct().join(t.master.select("cas"), "cas", "left_anti")


@query("etl03_same_cas_relations", """
WITH a AS (SELECT ord, cas, parent, first_value(ord) OVER (PARTITION BY cas ORDER BY sort_code, ord) AS anchor, count(*) FILTER (WHERE parent) OVER (PARTITION BY cas) AS parents, min(ord) FILTER (WHERE parent) OVER (PARTITION BY cas) AS parent_ord FROM master WHERE active)
SELECT anchor AS source, ord AS target, 'VARIANT' AS kind FROM a WHERE ord <> anchor UNION ALL SELECT parent_ord, ord, 'PARENT_CHILD' FROM a WHERE parents = 1 AND NOT parent""")
def same_cas_relations(t: Tables) -> DataFrame:
    active = t.master.where("active")
    heads = active.groupBy("cas").agg(F.min_by("ord", F.struct("sort_code", "ord")).alias("anchor"), F.count_if("parent").alias("parents"), F.min(F.when(F.col("parent"), F.col("ord"))).alias("parent_ord"))
    rows = active.join(heads, "cas")
    variants = rows.where("ord <> anchor").select(F.col("anchor").alias("source"), F.col("ord").alias("target"), F.lit("VARIANT").alias("kind"))
    return variants.unionByName(rows.where("parents = 1 AND NOT parent").select(F.col("parent_ord").alias("source"), F.col("ord").alias("target"), F.lit("PARENT_CHILD").alias("kind")))


@query("etl04_cross_relations", f"""
WITH {_TABLES} SELECT r.rule_id, r.source, r.target, r.decision <> '제외' AS has_rule, r.active AND p.ord IS NOT NULL AS active, p.ord IS NULL AS unresolved FROM rule r LEFT JOIN profile p ON p.ord = r.target""")
def cross_relations(t: Tables) -> DataFrame:
    """An excluded decision gives a relation without a rule, an unresolved end makes it inactive."""
    p = t.master.select(F.col("ord").alias("target"), F.lit(True).alias("known"))
    known = F.coalesce("known", F.lit(False))
    return rules(t).join(p, "target", "left").select("rule_id", "source", "target", (F.col("decision") != "제외").alias("has_rule"), (F.col("active") & known).alias("active"), (~known).alias("unresolved"))


#: Decisions that a review sheet may hold.
ITEM_DECISIONS, FINAL_DECISIONS = ("승인", "수정", "보류", "제외", "추가검토"), ("승인", "수정", "보류", "제외")
_ITEM, _FINAL = "CASE WHEN ord % 10 = 0 THEN '?' WHEN ord % 11 = 0 THEN '' ELSE decision END", "CASE WHEN ord % 13 = 0 THEN '미정' WHEN decision = '추가검토' THEN '보류' ELSE decision END"
_SHEET_CAS = "CASE WHEN ord % 14 = 0 THEN 'x' WHEN ord % 15 = 0 THEN '' WHEN ord % 16 = 0 THEN concat(cas, ' 등') ELSE cas END"
_YES = "CASE mark WHEN 'Y' THEN true WHEN 'N' THEN false END"


@query("etl05_loader_warnings", f"""
WITH r AS (SELECT ord, {_ITEM} AS item, {_FINAL} AS final, {_SHEET_CAS} AS cas, mark, {_YES} AS policy, ord % 25 = 0 AS self FROM master)
SELECT ord, 'UNKNOWN_ITEM_DECISION' AS code FROM r WHERE item NOT IN ('승인', '수정', '보류', '제외', '추가검토') UNION ALL SELECT ord, 'UNKNOWN_DEFAULT_RECOMMENDATION' FROM r WHERE mark NOT IN ('Y', 'N', '')
UNION ALL SELECT ord, 'NONSTANDARD_CAS' FROM r WHERE cas <> '' AND NOT regexp_matches(cas, '^[0-9]{{2,7}}-[0-9]{{2}}-[0-9]$') UNION ALL SELECT ord, 'UNKNOWN_FINAL_DECISION' FROM r WHERE final NOT IN ('승인', '수정', '보류', '제외')
UNION ALL SELECT ord, 'BLANK_RUNTIME_POLICY' FROM r WHERE final IN ('승인', '수정') AND policy IS NULL UNION ALL SELECT ord, 'SELF_RELATION' FROM r WHERE self""")
def loader_warnings(t: Tables) -> DataFrame:
    """What the loader of review sheets warns of: decisions and marks it does not know, odd numbers, approved rows without a policy, relations with oneself."""
    r = t.master.selectExpr("ord", f"{_ITEM} AS item", f"{_FINAL} AS final", f"{_SHEET_CAS} AS cas", "mark", f"{_YES} AS policy", "ord % 25 = 0 AS self")
    found = F.array_compact(F.array(
        F.when(~F.col("item").isin(*ITEM_DECISIONS), "UNKNOWN_ITEM_DECISION"), F.when(~F.col("mark").isin("Y", "N", ""), "UNKNOWN_DEFAULT_RECOMMENDATION"),
        F.when((F.col("cas") != "") & ~C.well_formed(F.col("cas")), "NONSTANDARD_CAS"), F.when(~F.col("final").isin(*FINAL_DECISIONS), "UNKNOWN_FINAL_DECISION"),
        F.when(F.col("final").isin("승인", "수정") & F.col("policy").isNull(), "BLANK_RUNTIME_POLICY"), F.when(F.col("self"), "SELF_RELATION"),
    ))
    return r.select("ord", F.explode(found).alias("code"))


@query("etl07_registry", """
WITH registry AS (SELECT ord AS id, sort_code, name, cas FROM master WHERE ord % 3 <> 0), by_code AS (SELECT sort_code, min(id) AS id FROM registry GROUP BY sort_code HAVING count(*) = 1), by_name AS (SELECT name, cas, min(id) AS id FROM registry GROUP BY ALL HAVING count(*) = 1),
req AS (SELECT ord, CASE WHEN ord % 4 = 0 THEN '' ELSE sort_code END AS code, name, cas FROM master)
SELECT r.ord, CASE WHEN r.code <> '' THEN c.id ELSE n.id END AS registered FROM req r LEFT JOIN by_code c ON c.sort_code = r.code LEFT JOIN by_name n ON n.name = r.name AND n.cas = r.cas""")
def registry(t: Tables) -> DataFrame:
    """Ids come back by a unique code; only without a code, by a unique name and number."""
    reg = t.master.where("ord % 3 <> 0").select(F.col("ord").alias("id"), "sort_code", "name", "cas")
    code = reg.groupBy(F.col("sort_code").alias("code")).agg(F.count("*").alias("n"), F.min("id").alias("by_code")).where("n = 1").drop("n")
    name = reg.groupBy("name", "cas").agg(F.count("*").alias("n"), F.min("id").alias("by_name")).where("n = 1").drop("n")
    req = t.master.select("ord", F.when(F.col("ord") % 4 == 0, "").otherwise(F.col("sort_code")).alias("code"), "name", "cas")
    return req.join(code, "code", "left").join(name, ["name", "cas"], "left").select("ord", F.when(F.col("code") != "", F.col("by_code")).otherwise(F.col("by_name")).alias("registered"))


@query("etl08_old_paths", "SELECT event_id FROM events WHERE contains(props, ': 4') AND NOT contains(props, ': 42')")
def old_paths(t: Tables) -> DataFrame:
    return t.events.where(F.contains("props", F.lit(": 4")) & ~F.contains("props", F.lit(": 42"))).select("event_id")


@query("rsv01_resolve", f"""
WITH {_TABLES}, req AS (SELECT ord AS request, cas, CASE WHEN ord % 2 = 0 THEN lower(name) ELSE 'other' END AS name FROM master WHERE ord % 6 = 0),
det AS (SELECT r.request, p.ord, p.active, CASE WHEN lower(regexp_replace(p.name, '[^0-9a-zA-Z가-힣]', '', 'g')) = lower(regexp_replace(r.name, '[^0-9a-zA-Z가-힣]', '', 'g')) THEN 'msds_detected' ELSE 'same_cas_variant' END AS tag FROM req r JOIN profile p USING (cas))
SELECT request, ord AS profile, tag FROM det WHERE active UNION SELECT d.request, g.ord, 'recommended' FROM det d JOIN rule u ON u.source = d.ord AND u.active JOIN profile g ON g.ord = u.target AND g.active""")
def resolve(t: Tables) -> DataFrame:
    """For each request the selectable profiles of its number, tagged, and what active rules of its profiles recommend."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[^0-9a-zA-Z가-힣]", ""))
    asked = F.when(F.col("ord") % 2 == 0, F.lower("name")).otherwise("other")
    req = t.master.where("ord % 6 = 0").select(F.col("ord").alias("request"), "cas", bare(asked).alias("asked"))
    hits = req.join(t.master.select("cas", "ord", bare(F.col("name")).alias("bare"), "active"), "cas")
    tag = F.when(F.col("bare") == F.col("asked"), "msds_detected").otherwise("same_cas_variant")
    detected = hits.where("active").select("request", F.col("ord").alias("profile"), tag.alias("tag"))
    on = rules(t).where("active").select(F.col("source").alias("ord"), F.col("target").alias("profile"))
    goal = t.master.where("active").select(F.col("ord").alias("profile"))
    recommended = hits.select("request", "ord").join(on, "ord").join(goal, "profile").select("request", "profile", F.lit("recommended").alias("tag"))
    return detected.unionByName(recommended).distinct()


#: Rules and contexts that try every branch of the condition.
_ASKED_RULE = "CASE seq % 6 WHEN 0 THEN '석면 불명' WHEN 1 THEN '석면' WHEN 2 THEN 'Welding 시 생성' WHEN 3 THEN '산화 조건' WHEN 4 THEN '석면 포함 활석' ELSE '항상' END"
_ASKED_RELATION = "CASE WHEN seq % 4 = 0 THEN 'CROSS' ELSE 'PROCESS_GENERATED' END"
_ASKED_STATUS = "CASE run_id % 5 WHEN 0 THEN 'Included' WHEN 1 THEN '불명' WHEN 2 THEN 'none' ELSE '' END"
_ASKED_CONTEXT = "CASE trace_id % 5 WHEN 0 THEN '용접 작업' WHEN 1 THEN '석면 포함 확인' WHEN 2 THEN '도장' WHEN 3 THEN 'HIGH 고열' ELSE '' END"
_ASKED_ANY = lambda text, tokens: "(" + " OR ".join(f"contains({text}, '{w}')" for w in tokens) + ")"


@query("rsv02_condition", f"""
WITH c AS (SELECT seq, lower({_ASKED_RULE}) AS condition, {_ASKED_RELATION} AS relation_type, lower({_ASKED_STATUS}) AS status, lower({_ASKED_STATUS} || ' ' || {_ASKED_CONTEXT}) AS context FROM journal)
SELECT seq, CASE WHEN contains(condition, '석면') AND {_ASKED_ANY("condition", D.ASBESTOS_OPEN)} THEN status IN ('included', 'unknown', '포함', '불명') OR {_ASKED_ANY("context", D.ASBESTOS_CONTEXT)}
    WHEN relation_type = 'PROCESS_GENERATED' AND {_ASKED_ANY("condition", D.HEAT)} THEN {_ASKED_ANY("context", D.HEAT)} ELSE true END AS met FROM c""")
def condition(t: Tables) -> DataFrame:
    """Asbestos of an open state needs a status or a word of the context; what a process generates by heat needs a word of heat in it."""
    holds = lambda text, tokens: F.exists(F.array(*map(F.lit, tokens)), lambda w: F.contains(text, w))
    rule, status = F.lower(F.expr(_ASKED_RULE)), F.lower(F.expr(_ASKED_STATUS))
    context = F.lower(F.concat_ws(" ", F.expr(_ASKED_STATUS), F.expr(_ASKED_CONTEXT)))
    open_state = F.contains(rule, F.lit(D.ASBESTOS)) & holds(rule, D.ASBESTOS_OPEN)
    met = (
        F.when(open_state, status.isin(*D.ASBESTOS_STATUS) | holds(context, D.ASBESTOS_CONTEXT))
        .when((F.expr(_ASKED_RELATION) == "PROCESS_GENERATED") & holds(rule, D.HEAT), holds(context, D.HEAT)).otherwise(True)
    )
    return t.journal.select("seq", met.alias("met"))


@query("rsv03_migrate", "WITH last AS (SELECT sort_code, max(ord) AS ord FROM master GROUP BY sort_code) SELECT m.ord AS selection, string_agg(CAST(l.ord AS STRING), ';' ORDER BY k.i) AS profiles FROM master m, LATERAL (VALUES (0, m.sort_code), (1, 'gone')) k(i, code) JOIN last l ON l.sort_code = k.code GROUP BY m.ord")
def migrate(t: Tables) -> DataFrame:
    """A saved selection of codes as profile ids; codes that are gone fall out."""
    last = t.master.groupBy(F.col("sort_code").alias("code")).agg(F.max("ord").alias("profile"))
    saved = t.master.select(F.col("ord").alias("selection"), F.posexplode(F.array("sort_code", F.lit("gone"))).alias("i", "code"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "profile"))), lambda x: x["profile"].cast("string")), ";")
    return saved.join(last, "code").groupBy("selection").agg(ids.alias("profiles"))
