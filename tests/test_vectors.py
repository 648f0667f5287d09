"""Fixed vectors of the concentration grammar, registry numbers, product names and ids."""

import hashlib
import unicodedata
import uuid

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayloom.functions import amounts, cas, content
from assayloom.functions import text as forms
from assayloom.operators import scalars, windows
from assayloom.operators.aggregates import gate_lock
from assayloom.sources import domain

CONTENT = """15~<20%|15~20%
1~<5|1~5%
0.1~1미만|0.1~<1%
0.01이내|≤0.01%
0.1 - 1|0.1~1%
0.1 ~ < 1%|0.1~<1%
>=95 - <= 100 %|95~100%
80 - 90|80~90%
<0.1%|<0.1%
≤ 0.1|≤0.1%
≥95%≤100%|95~100%
1 ~ 5미만|1~5%
0.1 ~ 1미만|0.1~<1%
5 ~ 1|1~5%
< 5 ~ 1|1~5%
min. 99.5%|≥99.5%
max 10|≤10%
99.0 <|>99%
98.0 +%|≥98%
(GR) 99.0 +% (EP) 98.0 +%|≥98%
0.1 ~ < 1 / 1 ~ 5|0.1~<1%
77.08g|미기재%
100 mg/kg|미기재%
Ethylene Glycol 50-60%|50~60%
95-100% (wt)|95~100%
Rem.|Rem.%
balance|Rem.%
잔량|Rem.%
2 미만|<2%
2 이하|≤2%
2 이상|≥2%
2 초과|>2%
99.5<|>99.5%
99.5>|<99.5%
2,00%|2.00%
0,1-1,0%|0.1~1.0%
5±1|4~6%
|미기재%"""
VECTORS = [tuple(x.rsplit("|", 1)) for x in CONTENT.split("\n")]


def test_content_vectors(spark):
    got = content.normalise(spark.createDataFrame(VECTORS, "s string, want string"), "s").collect()
    assert [(r.s, r.content_norm) for r in got] == VECTORS


def test_content_vectors_in_another_engine():
    t = pd.DataFrame(VECTORS, columns=["s", "want"])  # noqa: F841
    assert duckdb.sql(f"SELECT * FROM ({content.normalise_sql('SELECT * FROM t', 's')}) WHERE content_norm <> want").fetchall() == []


def test_normal_forms_are_fixed_points(spark):
    outputs = sorted({w for _, w in VECTORS})
    got = content.normalise(spark.createDataFrame([(o,) for o in outputs], "s string"), "s").collect()
    assert [r.content_norm for r in got] == [{"2.00%": "2%", "0.1~1.0%": "0.1~1%"}.get(o, o) for o in outputs]


@pytest.mark.parametrize(
    ("number", "grounding", "want"),
    [("13463-67-7", "", True), ("2014-12-16", "", False), ("2025-03-17", "", False), ("7732-18-5", "", True), ("64742-54-7", "oil 64742 - 54 - 7", True), ("해당없음", "", True), ("140-11-5", "", False), ("205-399-7", "", False), ("", "", False)],
)
def test_genuine(spark, number, grounding, want):
    df = spark.createDataFrame([(number, grounding)], "c string, g string")
    assert df.select(cas.genuine(F.col("c"), F.lit(False), F.col("g"))).first()[0] is want


def test_separators(spark):
    df = spark.createDataFrame([(" 64 – 17‑5 ", "a 64 – 17 - 5 on 2024-01-12, 10 - 20 %")], "c string, t string")
    assert tuple(df.select(cas.normalise(F.col("c")), cas.normalise_in_text(F.col("t"))).first()) == ("64-17-5", "a 64-17-5 on 2024-01-12, 10 - 20 %")


def test_legacy_bounds(spark):
    want = {"0.1~<1": ("0", "1"), ">=10": ("10", "10"), "": ("100", "100"), "5 - 10%": ("5", "10"), "<5": ("0", "5")}
    got = spark.createDataFrame([(k,) for k in want], "c string").select("c", content.legacy_min_max(F.col("c")).alias("x")).collect()
    assert {r.c: tuple(r.x) for r in got} == want


def test_uuid5(spark):
    names = ["", "a", "탄산|x", "SP_1|SP_2|SAME|1"]
    for space in (domain.PROFILE_NAMESPACE, domain.RELATION_NAMESPACE, domain.RULE_NAMESPACE):
        got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalars.uuid5(F.col("n"), space)).collect()]
        assert got == [uuid.uuid5(uuid.UUID(space), n).hex.upper() for n in names]


def test_plain_forms_are_what_the_steps_give(spark):
    texts = [f"{lead}{sign}{a}{mid}" for lead in ("", " ") for sign in ("", "<", "> ", "≤", "≥ ") for a in (0, 1, 5, 99, 100, 110, 111, 999) for mid in ("", "%", " % ")]
    texts += [f"{a}{mid}{b}{tail}" for a in (0, 1, 5, 12, 110) for b in (1, 5, 12, 100, 110, 111) for mid in ("-", " ~ ") for tail in ("", " %")] + ["", "미기재%", "005", "05 - 010"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    steps = df
    for name, expression in content.steps("s", content.Spark()):
        steps = steps.withColumn(name, F.expr(expression))
    want, got = {r.s: r._out for r in steps.select("s", "_out").collect()}, {r.s: r.f for r in df.select("s", content.plain_form(F.col("s")).alias("f")).collect()}
    assert {s: f for s, f in got.items() if f is not None} == {s: want[s] for s, f in got.items() if f is not None}
    assert sum(f is not None for f in got.values()) > 150


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_ids_and_names_in_plain_python(spark):
    got = one(spark, scalars.file_trace_id(F.lit("run-1"), F.lit("h")), scalars.safe_export_name(F.lit("a<b>: 제품 sheet.pdf"), F.lit("ab-12 cd345678")), scalars.safe_export_name(F.lit("x" * 200), F.lit("")), scalars.safe_export_name(F.lit(".pdf"), F.lit("--")))
    assert got == (hashlib.sha256(b"run-1\0h").hexdigest()[:24], "a_b__제품_sheet__ab12cd34", "x" * 71 + "__unknown", "diagnostic__unknown")


def test_redaction_by_key_and_text():
    long = "Ab3+" * 30
    value = {"API-key": {"a": 1}, "x": [{"token": 5, "note": "Basic abc, d"}, f"<{long}>", 3, None], "pem": "-----BEGIN X-----\nq\n-----END X----- z"}
    assert scalars.redact_value(value) == {"API-key": "[REDACTED]", "x": [{"token": "[REDACTED]", "note": "Basic [REDACTED], d"}, "<[REDACTED BASE64]>", 3, None], "pem": "[REDACTED SERVICE ACCOUNT KEY] z"}


AMOUNTS = [
    ("10~20%", "10~20%", "10~20%", "10~20%"), ("20 - 10 %", "10~20%", "10~20%", "20 - 10 %"), (">= 35 - < 40 %", "35~<40%", "35~<40%", ">= 35 - < 40 %"),
    ("1-0%, 5 ~ 1", "0~1%, 1~5", "0~1%", "1-0%, 5 ~ 1"), ("5 이상 ~ 10 % 미만", "5~<10%", "5~<10%", "5 이상 ~ 10 % 미만"), ("2,50% 이하", "2,50% 이하", "≤2.50%", "≤50%"),
    ("3.0 % 미맊", "3.0 % 미만", "<3%", "3%"), ("7% 초과", "7% 초과", ">7%", ">7%"), ("150 %", "150 %", "150%", "미기재%"), ("balance", "balance", "balance%", "balance"),
    ("≧ 5.50%", "≧ 5.50%", "5.5%", "≥5.5%"), ("15~1 and 5~1", "1~15and 1~5", "1~15%", "15~1 and 5~1"),
]


def test_older_amount_rules(spark):
    df = spark.createDataFrame([(a,) for a, *_ in AMOUNTS], "s string").coalesce(1)
    for i, (steps, out) in enumerate(((amounts.clean_steps, "clean"), (amounts.percentage_steps, "percentage"), (amounts.single_steps, "single")), 1):
        got = {r.s: r[out] for r in amounts.apply(df, steps("s", amounts.Spark()), out).collect()}
        assert got == {x[0]: x[i] for x in AMOUNTS}


def test_compatibility_forms(spark):
    texts = ["Ｗｅｌｄ　１２％", "①²½", "㎎/㎥", "plain", "가각", "ﬁx", "～＜５＞"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(forms.fold(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFKC", t) if t not in ("①²½", "ﬁx") else t.replace("①", "1").replace("²", "2") for t in texts]


def test_pure_and_core_names(spark):
    pure = [("측정 비대상 [특별] [아세톤](5%)", "아세톤"), ("보관[허가]벤젠 (1~2%)", "벤젠"), ("크롬(III) 및 그 화합물", "크롬 및 그 화합물")]
    core = [("바륨 및 그 가용성 화합물", "바륨"), ("활석(석면불포함)", "활석"), ("망간 및 그 무기화합물", "망간 및 그"), ("글리콜에테르 계열", "글리콜에테르")]
    for vectors, rule in ((pure, scalars.pure_substance), (core, scalars.core_name)):
        got = [r[0] for r in spark.createDataFrame([(x,) for x, _ in vectors], "x string").coalesce(1).select(rule(F.col("x"))).collect()]
        assert got == [y for _, y in vectors]


def test_column_letters(spark):
    want = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 702: "ZZ", 703: "AAA"}
    got = spark.createDataFrame([(k,) for k in want], "i long").select("i", scalars.column_letters(F.col("i")).alias("l")).collect()
    assert {r.i: r.l for r in got} == want


def test_column_letters_beyond_three(spark):
    want = {18278: "ZZZ", 18279: "AAAA", 475254: "ZZZZ", 475255: "AAAAA", 2**53 + 1: "BKTXHSOGHKKG", 2**63 - 1: "CRPXNLSKVLJFHG"}
    rows = spark.createDataFrame([(k,) for k in want], "i long").select("i", scalars.column_letters(F.col("i")).alias("l"))
    got = rows.withColumn("back", scalars.column_index(F.col("l"))).collect()
    assert {r.i: (r.l, r.back) for r in got} == {k: (v, k) for k, v in want.items()}


def fold(values):
    """A candidate replaces the kept one if that is missing and it is not, or if it is a range and the kept one is stated and none."""
    kept = values[0]
    for v in values[1:]:
        missing = kept in ("", content.MISSING)
        if (missing and v not in ("", content.MISSING)) or (not missing and "~" not in kept and "~" in v):
            kept = v
    return kept


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "미기재%", "5%", "7%", "1~2%", "3~4%"]), min_size=1, max_size=5), min_size=20, max_size=60))
def test_gate_lock_is_the_fold(spark, groups):
    rows = [(d, "64-17-5", i, v) for d, g in enumerate(groups) for i, v in enumerate(g)]
    got = {r.doc_id: r.content for r in gate_lock(spark.createDataFrame(rows, "doc_id long, cas string, seq long, content string")).collect()}
    assert got == {d: fold(g) for d, g in enumerate(groups)}


def test_retention_does_not_count_dropped_runs(spark):
    runs = [(1, 100, 39), (2, 5000, 39), (3, 100, 39), (4, 100, 1), (5, 100, 39), (6, 100, 39)]
    df = spark.createDataFrame([(runs,)], "runs array<struct<id:bigint,size:bigint,day:bigint>>")
    assert df.select(windows.retained(F.col("runs"), 350, 5, 40, 30).alias("k")).first().k == [1, 3, 5]
