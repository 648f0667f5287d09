"""The validator of a reviewed index: profiles, relations, rules, counts and paths, each issue a row.

Every code is a filter, an anti join or a group over one of the tables; their union is the report. An active relation or rule gives an
issue for each of its two ends. A profile without an id gets MISSING_PROFILE_ID and no other issue of profiles, so a code for one that lacks
its number as well (CASLESS_PROFILE_WITHOUT_ID) can never occur and is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import cas as C

#: The word that marks a raw number, the version of the master's profiles, and paths that were given up.
RAW_MARK, MASTER_VERSION, OLD_PATHS = "등", "msds_index_V24", ("old/index_V23", "legacy.xlsx")


def bare_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s\-_·,./()\[\]{}]", ""))


def issues(
    profile: DataFrame, relation: DataFrame, rule: DataFrame, expected: int | None = None, source_rows: int | None = None, decisions: tuple[int, int] | None = None,
    referenced: DataFrame | None = None, present: DataFrame | None = None, texts: DataFrame | None = None,
) -> DataFrame:
    """severity, code, entity, entity_id.

    profile: profile_id, cas_no, cas_no_raw, parent_profile_id, is_parent, active, default_recommended, selectable, canonical_name, source_version. relation: relation_id,
    source, target, active, review_status. rule: rule_id, source, target, active, final_decision, review_status, require_user_confirmation, auto_confirmed,
    default_selected, allow_multiple, target_cas, target_name. expected, source_rows: rows of the master. decisions: loaded and converted ones. referenced, present: path.
    texts: path, text.
    """

    def made(df: DataFrame, when: Column | str, code: str, entity: str, key: Column | str | None, severity: str = "ERROR") -> DataFrame:
        shown = F.lit(None).cast("string") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
        return df.where(when).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(entity).alias("entity"), shown.alias("entity_id"))

    twice = lambda df, key: df.where(f"{key} IS NOT NULL AND {key} <> ''").groupBy(key).count().where("count > 1")
    named = profile.where("profile_id IS NOT NULL AND profile_id <> ''")
    known = named.groupBy(F.col("profile_id").alias("end")).agg(F.bool_or("active").alias("end_active"), F.max("cas_no").alias("end_cas"), F.max("canonical_name").alias("end_name"))
    parents = named.where("parent_profile_id IS NOT NULL").join(known.select(F.col("end").alias("parent_profile_id")), "parent_profile_id", "left_anti")

    def ends(df: DataFrame) -> DataFrame:
        """Each active row once for each of its ends."""
        return df.where("active").withColumn("end", F.explode(F.array("source", "target"))).join(known, "end", "left")

    rel, rul = ends(relation), ends(rule)
    goals = rule.join(known.withColumnRenamed("end", "target"), "target")
    groups = profile.where("active AND is_parent AND cas_no IS NOT NULL AND cas_no <> ''").groupBy("cas_no").count()
    p = [
        made(twice(profile, "profile_id"), "true", "DUPLICATE_PROFILE_ID", "profile", "profile_id"),
        made(profile, "profile_id IS NULL OR profile_id = ''", "MISSING_PROFILE_ID", "profile", None),
        made(named, F.col("cas_no").isNotNull() & (F.col("cas_no") != "") & ~C.well_formed(F.col("cas_no")), "NONSTANDARD_RUNTIME_CAS", "profile", "profile_id"),
        made(named, F.contains("cas_no", F.lit(RAW_MARK)), "CAS_RAW_USED_AS_RUNTIME_KEY", "profile", "profile_id"),
        made(named, F.contains("cas_no_raw", F.lit(RAW_MARK)) & (F.col("cas_no") == F.col("cas_no_raw")), "CAS_RAW_NOT_SEPARATED", "profile", "profile_id"),
        made(parents, "true", "MISSING_PARENT_PROFILE", "profile", "profile_id"),
        made(named, "is_parent AND NOT active", "INACTIVE_PARENT_PROFILE", "profile", "profile_id", "WARNING"),
        made(named, "default_recommended AND NOT selectable", "DEFAULT_RECOMMENDED_NOT_SELECTABLE", "profile", "profile_id", "WARNING"),
        made(twice(relation, "relation_id"), "true", "DUPLICATE_RELATION_ID", "relation", "relation_id"),
        made(rel, "end_active IS NULL", "ACTIVE_RELATION_PROFILE_MISSING", "relation", "relation_id"), made(rel, "NOT end_active", "ACTIVE_RELATION_PROFILE_INACTIVE", "relation", "relation_id"),
        made(relation, "source = target", "SELF_RELATION", "relation", "relation_id"),
        made(relation, "review_status = 'REVIEW_REQUIRED' AND active", "REVIEW_RELATION_ACTIVE", "relation", "relation_id"),
        made(twice(rule, "rule_id"), "true", "DUPLICATE_RULE_ID", "rule", "rule_id"), made(rule, "final_decision = '제외'", "EXCLUDED_RULE_EMITTED", "rule", "rule_id"),
        made(rule, "review_status = 'REVIEW_REQUIRED' AND active", "REVIEW_RULE_ACTIVE", "rule", "rule_id"), made(rule, "final_decision = '보류' AND active", "HELD_RULE_ACTIVE", "rule", "rule_id"),
        made(rule, "require_user_confirmation AND auto_confirmed", "USER_CONFIRMATION_BYPASSED", "rule", "rule_id"),
        made(rul, "end_active IS NULL", "ACTIVE_RULE_PROFILE_MISSING", "rule", "rule_id"), made(rul, "NOT end_active", "ACTIVE_RULE_PROFILE_INACTIVE", "rule", "rule_id"),
        made(rule, "default_selected AND NOT allow_multiple", "DEFAULT_SELECTED_SINGLE_POLICY", "rule", "rule_id", "WARNING"),
        made(goals, "target_cas <> '' AND NOT (end_cas <=> target_cas)", "TARGET_CAS_DIRECTION_MISMATCH", "rule", "rule_id"),
        made(goals, bare_name(F.col("target_name")) != bare_name(F.col("end_name")), "TARGET_NAME_NORMALIZED", "rule", "rule_id", "WARNING"),
        made(groups, "count > 1", "MULTIPLE_PARENT_PROFILES", "cas_group", "cas_no", "WARNING"),
    ]
    one = profile.sparkSession.range(1)
    if expected is not None:
        if source_rows is not None:
            p.append(made(one, F.lit(source_rows != expected), "SOURCE_ROW_COUNT_MISMATCH", "dataset", None))
        count = profile.agg(F.count_if(F.col("source_version") == MASTER_VERSION).alias("n"))
        p.append(made(count, F.col("n") != expected, "MASTER_PROFILE_COUNT_MISMATCH", "dataset", None))
    if decisions is not None:
        p.append(made(one, F.lit(decisions[0] != decisions[1]), "REVIEW_DECISION_COUNT_MISMATCH", "dataset", None))
    if referenced is not None and present is not None:
        p.append(made(referenced.join(present, "path", "left_anti"), "true", "REFERENCE_PATH_MISSING", "path", "path"))
    if texts is not None:
        held = texts.select("path", F.explode(F.filter(F.array(*map(F.lit, OLD_PATHS)), lambda w: F.contains("text", w))).alias("old"))
        p.append(made(held, "true", "OLD_PATH_REFERENCE", "path", "old"))
    return reduce(DataFrame.unionByName, p)


#: The carriers of the three tables, in both dialects: what is wrong with a row follows from its number.
_PROFILE = {
    "profile_id": "CASE WHEN ord % 83 = 0 THEN NULL ELSE concat('P', CAST(ord AS STRING)) END",
    "cas_no": "CASE WHEN ord % 50 = 0 THEN replace(cas, '-', '') WHEN ord % 51 = 0 THEN concat(cas, ' 등') WHEN ord % 60 = 7 THEN NULL ELSE cas END",
    "cas_no_raw": "CASE WHEN ord % 102 = 0 THEN concat(cas, ' 등') ELSE cas END",
    "parent_profile_id": "CASE WHEN ord % 31 = 0 THEN concat('P', CAST(ord - 1 AS STRING)) WHEN ord % 97 = 0 THEN 'P-none' END",
    "is_parent": "parent", "active": "active", "default_recommended": "decision = '승인'", "selectable": "decision = '수정' OR (decision = '승인' AND ord % 3 <> 0)",
    "canonical_name": "name", "source_version": "CASE WHEN ord % 70 = 1 THEN 'other' ELSE 'msds_index_V24' END",
}
_RELATION = {
    "relation_id": "concat('R', CAST(ord AS STRING))", "source": "CASE WHEN ord % 44 = 0 THEN NULL ELSE concat('P', CAST(ord AS STRING)) END",
    "target": "concat('P', CAST(CASE WHEN ord % 40 = 0 THEN ord WHEN ord % 41 = 0 THEN -ord ELSE ord + 3 END AS STRING))", "active": "active AND ord % 4 <> 1",
    "review_status": "CASE WHEN decision = '보류' THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END",
}
_RULE = {
    "rule_id": "concat('U', CAST(ord AS STRING))", "source": "concat('P', CAST(ord AS STRING))", "target": "concat('P', CAST(ord + CASE WHEN ord % 5 = 0 THEN 0 ELSE 7 END AS STRING))",
    "active": "active AND ord % 6 <> 1", "final_decision": "decision", "review_status": "CASE WHEN ord % 9 = 0 THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END",
    "require_user_confirmation": "mark IN ('Y', '1')", "auto_confirmed": "ord % 2 = 0", "default_selected": "mark = '예'", "allow_multiple": "ord % 2 = 0", "target_cas": "CASE WHEN ord % 8 = 0 THEN '' ELSE cas END",
    "target_name": "CASE WHEN ord % 10 = 5 THEN lower(replace(name, ' ', '-')) ELSE name END",
}
#: (columns, which rows come twice)
_CARRIERS = {"profile": (_PROFILE, "ord % 71 = 0"), "relation": (_RELATION, "ord % 73 = 0"), "rule": (_RULE, "ord % 79 = 0")}


def carrier(t: Tables, name: str) -> DataFrame:
    columns, twice = _CARRIERS[name]
    rows = [f"{e} AS {c}" for c, e in columns.items()]
    return t.master.selectExpr(*rows).unionByName(t.master.where(twice).selectExpr(*rows))


def _carrier_sql(name: str) -> str:
    columns, twice = _CARRIERS[name]
    rows = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"{name} AS (SELECT {rows} FROM master UNION ALL SELECT {rows} FROM master WHERE {twice})"


_PATHS = "CASE WHEN n_nationkey % 4 = 0 THEN 'gone' ELSE n_name END"
_TEXTS = "CASE n_nationkey % 5 WHEN 0 THEN 'see old/index_V23/a and legacy.xlsx' WHEN 1 THEN 'legacy.xlsx' ELSE 'new' END"
_ENDS = "SELECT {0}_id, k.active AS end_active, k.profile_id IS NOT NULL AS found FROM (SELECT {0}_id, source AS e FROM {0} WHERE active UNION ALL SELECT {0}_id, target FROM {0} WHERE active) x LEFT JOIN known k ON k.profile_id = x.e"
_NAME = r"lower(regexp_replace(coalesce({}, ''), '[\s\-_·,./()\[\]{{}}]', '', 'g'))"


def _from(table: str, when: str, code: str, entity: str, key: str, severity: str = "ERROR") -> str:
    return f"SELECT '{severity}' AS severity, '{code}' AS code, '{entity}' AS entity, CAST({key} AS STRING) AS entity_id FROM {table} WHERE {when}"


_REPORT = f"""
WITH {", ".join(map(_carrier_sql, _CARRIERS))}, named AS (SELECT * FROM profile WHERE profile_id IS NOT NULL),
known AS (SELECT profile_id, bool_or(active) AS active, max(cas_no) AS cas_no, max(canonical_name) AS canonical_name FROM named GROUP BY profile_id),
rel AS ({_ENDS.format("relation")}), rul AS ({_ENDS.format("rule")}), goal AS (SELECT r.*, k.cas_no, k.canonical_name FROM rule r JOIN known k ON k.profile_id = r.target),
ref AS (SELECT {_PATHS} AS path FROM nation), txt AS (SELECT {_TEXTS} AS text FROM nation), old(path) AS (VALUES ('old/index_V23'), ('legacy.xlsx'))
{" UNION ALL ".join((
    _from("named", "true GROUP BY profile_id HAVING count(*) > 1", "DUPLICATE_PROFILE_ID", "profile", "profile_id"), _from("profile", "profile_id IS NULL", "MISSING_PROFILE_ID", "profile", "NULL"),
    _from("named", "NOT regexp_matches(cas_no, '^[0-9]{2,7}-[0-9]{2}-[0-9]$')", "NONSTANDARD_RUNTIME_CAS", "profile", "profile_id"), _from("named", "contains(cas_no, '등')", "CAS_RAW_USED_AS_RUNTIME_KEY", "profile", "profile_id"),
    _from("named", "contains(cas_no_raw, '등') AND cas_no = cas_no_raw", "CAS_RAW_NOT_SEPARATED", "profile", "profile_id"),
    _from("named", "parent_profile_id IS NOT NULL AND parent_profile_id NOT IN (SELECT profile_id FROM known)", "MISSING_PARENT_PROFILE", "profile", "profile_id"),
    _from("named", "is_parent AND NOT active", "INACTIVE_PARENT_PROFILE", "profile", "profile_id", "WARNING"), _from("named", "default_recommended AND NOT selectable", "DEFAULT_RECOMMENDED_NOT_SELECTABLE", "profile", "profile_id", "WARNING"),
    _from("relation", "true GROUP BY relation_id HAVING count(*) > 1", "DUPLICATE_RELATION_ID", "relation", "relation_id"), _from("rel", "NOT found", "ACTIVE_RELATION_PROFILE_MISSING", "relation", "relation_id"),
    _from("rel", "found AND NOT end_active", "ACTIVE_RELATION_PROFILE_INACTIVE", "relation", "relation_id"), _from("relation", "source = target", "SELF_RELATION", "relation", "relation_id"),
    _from("relation", "review_status = 'REVIEW_REQUIRED' AND active", "REVIEW_RELATION_ACTIVE", "relation", "relation_id"), _from("rule", "true GROUP BY rule_id HAVING count(*) > 1", "DUPLICATE_RULE_ID", "rule", "rule_id"),
    _from("rule", "final_decision = '제외'", "EXCLUDED_RULE_EMITTED", "rule", "rule_id"), _from("rule", "review_status = 'REVIEW_REQUIRED' AND active", "REVIEW_RULE_ACTIVE", "rule", "rule_id"),
    _from("rule", "final_decision = '보류' AND active", "HELD_RULE_ACTIVE", "rule", "rule_id"), _from("rule", "require_user_confirmation AND auto_confirmed", "USER_CONFIRMATION_BYPASSED", "rule", "rule_id"),
    _from("rul", "NOT found", "ACTIVE_RULE_PROFILE_MISSING", "rule", "rule_id"), _from("rul", "found AND NOT end_active", "ACTIVE_RULE_PROFILE_INACTIVE", "rule", "rule_id"),
    _from("rule", "default_selected AND NOT allow_multiple", "DEFAULT_SELECTED_SINGLE_POLICY", "rule", "rule_id", "WARNING"),
    _from("goal", "target_cas <> '' AND cas_no IS DISTINCT FROM target_cas", "TARGET_CAS_DIRECTION_MISMATCH", "rule", "rule_id"),
    _from("goal", f"{_NAME.format('target_name')} <> {_NAME.format('canonical_name')}", "TARGET_NAME_NORMALIZED", "rule", "rule_id", "WARNING"),
    _from("profile", "active AND is_parent AND cas_no IS NOT NULL GROUP BY cas_no HAVING count(*) > 1", "MULTIPLE_PARENT_PROFILES", "cas_group", "cas_no", "WARNING"),
    _from("(SELECT 1)", "297 <> 300", "SOURCE_ROW_COUNT_MISMATCH", "dataset", "NULL"), _from("(SELECT count(*) FILTER (WHERE source_version = 'msds_index_V24') AS n FROM profile)", "n <> 300", "MASTER_PROFILE_COUNT_MISMATCH", "dataset", "NULL"),
    _from("(SELECT 1)", "305 <> 304", "REVIEW_DECISION_COUNT_MISMATCH", "dataset", "NULL"), _from("ref", "path NOT IN (SELECT n_name FROM nation)", "REFERENCE_PATH_MISSING", "path", "path"),
    _from("txt, old", "contains(text, path)", "OLD_PATH_REFERENCE", "path", "path"),
))}"""


@query("etl06_validator", _REPORT)
def validate_index(t: Tables) -> DataFrame:
    referenced, present = t.nation.select(F.expr(_PATHS).alias("path")), t.nation.select(F.col("n_name").alias("path"))
    texts = t.nation.select(F.col("n_name").alias("path"), F.expr(_TEXTS).alias("text"))
    return issues(*(carrier(t, n) for n in _CARRIERS), expected=300, source_rows=297, decisions=(305, 304), referenced=referenced, present=present, texts=texts)


@query("agg21_severity_counts", _REPORT.replace("SELECT 'ERROR' AS severity, 'DUPLICATE_PROFILE_ID'", "report AS (SELECT 'ERROR' AS severity, 'DUPLICATE_PROFILE_ID'", 1).replace("VALUES ('old/index_V23'), ('legacy.xlsx'))", "VALUES ('old/index_V23'), ('legacy.xlsx')),", 1) + ")\nSELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, CASE WHEN count(*) FILTER (WHERE severity = 'ERROR') = 0 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM report")
def severity_counts(t: Tables) -> DataFrame:
    """The validator's report in a line: it passes if it holds no error."""
    n = lambda kind: F.count_if(F.col("severity") == kind)
    return validate_index(t).agg(n("ERROR").alias("errors"), n("WARNING").alias("warnings"), F.when(n("ERROR") == 0, "PASS").otherwise("FAIL").alias("outcome"))
