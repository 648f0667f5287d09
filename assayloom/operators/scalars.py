"""Scalar functions over registry numbers, concentrations, names, marks, ids and files, each as a query over a carrier."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import cas as C
from ..functions import amounts as A
from ..functions import content as N
from ..functions.text import fold, fold_sql
from ..sources import domain as D
from .predicates import _CHECK
from .windows import natural_key


def strip_runs(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@query("scl01_cas_normalise", "SELECT doc_id, seq, cas AS normal FROM component")
def cas_normalise(t: Tables) -> DataFrame:
    """Whatever dash, spaces and full-width digits a number was written with, its normal form comes back."""
    wide = F.translate("cas", "0123456789", "０１２３４５６７８９")
    written = F.when(F.col("seq") % 3 == 0, wide).otherwise(F.col("cas"))
    odd = F.concat(F.lit(" "), F.replace(written, F.lit("-"), F.when(F.col("seq") % 2 == 0, F.lit(" – ")).otherwise(F.lit("‑"))), F.lit(" "))
    return t.component.select("doc_id", "seq", C.normalise(odd).alias("normal"))


@query("scl02_cas_in_text", "SELECT doc_id, seq, 'see ' || cas || ' of 2024-01-12, 10 - 20 %' AS line FROM component")
def cas_in_text(t: Tables) -> DataFrame:
    line = F.concat(F.lit("see "), F.replace("cas", F.lit("-"), F.lit(" – ")), F.lit(" of 2024-01-12, 10 - 20 %"))
    return t.component.select("doc_id", "seq", C.normalise_in_text(line).alias("line"))


@query("scl03_decimal_comma", "SELECT doc_id, seq, 'a, b ' || CAST(quantity AS STRING) || '.5% 1,000 kg' AS line FROM component")
def decimal_comma(t: Tables) -> DataFrame:
    line = F.concat(F.lit("a, b "), F.col("quantity").cast("string"), F.lit(",5% 1,000 kg"))
    return t.component.select("doc_id", "seq", F.regexp_replace(line, r"([0-9]),([0-9]+\s*%)", "$1.$2").alias("line"))


#: Contents as sheets write and scanners misread them, put around the carrier's.
_ODD_CONTENT = "CASE seq % 9 WHEN 0 THEN replace(content, '미만', '미 맊') WHEN 1 THEN concat('>= ', CAST(quantity AS STRING), ' - < ', CAST(quantity + 5 AS STRING), ' %') WHEN 2 THEN concat(CAST(quantity + 9 AS STRING), '-0% and 5 ~ 1') WHEN 3 THEN concat(CAST(quantity AS STRING), ' 이상 ~ 90 % 미만') WHEN 4 THEN concat(CAST(quantity AS STRING), ',50% 이핚') WHEN 5 THEN concat('>=1 - <= ', CAST(quantity AS STRING), ' %') ELSE content END"
_ODD = f"SELECT doc_id, seq, {_ODD_CONTENT} AS written FROM component"


def odd_contents(t: Tables) -> DataFrame:
    return t.component.select("doc_id", "seq", F.expr(_ODD_CONTENT).alias("written"))


@query("scl04_clean_content", f"SELECT doc_id, seq, clean FROM ({A.apply_sql(_ODD, A.clean_steps('written', A.DuckDB()), 'clean')})")
def clean_contents(t: Tables) -> DataFrame:
    return A.apply(odd_contents(t), A.clean_steps("written", A.Spark()), "clean").drop("written")


@query("scl05_clean_percentage", f"SELECT doc_id, seq, shown FROM ({A.apply_sql(_ODD, A.percentage_steps('written', A.DuckDB()), 'shown')})")
def clean_percentage(t: Tables) -> DataFrame:
    return A.apply(odd_contents(t), A.percentage_steps("written", A.Spark()), "shown").drop("written")


@query("scl06_single_value", f"SELECT doc_id, seq, shown FROM ({A.apply_sql(_ODD, A.single_steps('written', A.DuckDB()), 'shown')})")
def single_value(t: Tables) -> DataFrame:
    return A.apply(odd_contents(t), A.single_steps("written", A.Spark()), "shown").drop("written")


@query("scl07_content_normalise", N.normalise_sql("SELECT doc_id, seq, content FROM component", "content"))
def content_normalise(t: Tables) -> DataFrame:
    return N.normalise_distinct(t.component.select("doc_id", "seq", "content"), "content")


@query("scl08_refine_strict", f"SELECT doc_id, seq, cas, content_norm FROM ({N.normalise_sql('SELECT doc_id, seq, cas, content FROM component', 'content')}) WHERE {_CHECK}")
def refine_strict(t: Tables) -> DataFrame:
    valid = t.component.where(C.checksum_holds(F.col("cas"))).select("doc_id", "seq", "cas", "content")
    return N.normalise_distinct(valid, "content").drop("content")


@query("scl09_min_max", r"""
WITH b AS (SELECT doc_id, seq, regexp_replace(content, '\s', '', 'g') AS s FROM component), x AS (SELECT *, regexp_extract(s, '([0-9]+(?:\.[0-9]+)?)%?[~-]([0-9]+(?:\.[0-9]+)?)', 1) AS a, regexp_extract(s, '([0-9]+(?:\.[0-9]+)?)%?[~-]([0-9]+(?:\.[0-9]+)?)', 2) AS b,
 regexp_extract(s, '[<≤]([0-9]+(?:\.[0-9]+)?)', 1) AS lt, regexp_extract(s, '[>≥]([0-9]+(?:\.[0-9]+)?)', 1) AS gt, regexp_extract(s, '[0-9]+(?:\.[0-9]+)?', 0) AS one FROM b)
SELECT doc_id, seq, CASE WHEN s = '' OR contains(s, '미기재') THEN '100' WHEN a <> '' THEN a WHEN lt <> '' THEN '0' WHEN gt <> '' THEN gt WHEN one <> '' THEN one ELSE '100' END AS lo,
 CASE WHEN s = '' OR contains(s, '미기재') THEN '100' WHEN a <> '' THEN b WHEN lt <> '' THEN lt WHEN gt <> '' THEN '100' WHEN one <> '' THEN one ELSE '100' END AS hi FROM x""")
def min_max(t: Tables) -> DataFrame:
    return t.component.withColumn("x", N.legacy_min_max(F.col("content"))).select("doc_id", "seq", "x.lo", "x.hi")


@query("scl10_chain", f"""
WITH k AS (SELECT doc_id, seq, cas, CASE WHEN lower(content) IN ('', 'none', 'null', '미기재%') THEN '미기재%' WHEN regexp_matches(lower(content), 'balance|remainder|rest|residual|잔량|나머지|^rem') THEN 'Rem.' WHEN contains(content, '%') THEN lower(content) ELSE lower(content) || '%' END AS shown FROM component WHERE {_CHECK})
SELECT doc_id, string_agg(cas || '(' || shown || ')', '; ' ORDER BY seq) AS chain FROM k GROUP BY doc_id""")
def chain(t: Tables) -> DataFrame:
    low = F.lower("content")
    shown = (
        F.when(low.isin("", "none", "null", N.MISSING), N.MISSING).when(low.rlike("balance|remainder|rest|residual|잔량|나머지|^rem"), "Rem.")
        .when(F.contains("content", F.lit("%")), low).otherwise(F.concat(low, F.lit("%")))
    )
    rows = t.component.where(C.checksum_holds(F.col("cas"))).select("doc_id", F.struct("seq", F.concat("cas", F.lit("("), shown, F.lit(")")).alias("item")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), "; ").alias("chain"))


def parse_chain(text: Column) -> Column:
    """Items of "number(content); ...": the number, and what its parenthesis holds, further ones inside it included."""
    items = F.filter(F.transform(F.split(text, r";\s*(?=[0-9]{2,7}-[0-9]{2}-[0-9]\(|$)"), lambda s: F.trim(s)), lambda s: s.rlike(r"^[0-9]{2,7}-[0-9]{2}-[0-9]"))
    return F.transform(items, lambda s: F.struct(F.regexp_extract(s, r"^([0-9]{2,7}-[0-9]{2}-[0-9])", 1).alias("cas"), F.regexp_extract(s, r"(?s)^[0-9-]+\((.*)\)[^()]*$", 1).alias("content")))


@query("scl11_chain_parse", "SELECT doc_id, seq, cas, content FROM component")
def chain_parse(t: Tables) -> DataFrame:
    """Chains are written and read back: every component returns, contents with parentheses too."""
    item = F.struct("seq", F.concat("cas", F.lit("("), "content", F.lit(")")).alias("item"))
    chains = t.component.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    back = chains.select("doc_id", F.posexplode(F.arrays_zip(F.transform("x", lambda x: x["seq"]).alias("seq"), parse_chain(F.array_join(F.transform("x", lambda x: x["item"]), "; ")).alias("c"))).alias("i", "y"))
    return back.select("doc_id", "y.seq", "y.c.cas", "y.c.content")


_VALUE = r"list_max(list_transform(regexp_extract_all(content, '[0-9]+(?:\.[0-9]+)?', 0), lambda x: CAST(x AS DECIMAL(20, 6))))"


@query("scl12_one_percent", f"SELECT doc_id, seq, CASE WHEN {_VALUE} IS NULL THEN true WHEN contains(content, '<') AND {_VALUE} <= 1 THEN false ELSE {_VALUE} >= 1 END AS measured FROM component")
def one_percent(t: Tables) -> DataFrame:
    return t.component.select("doc_id", "seq", (N.measured_value(F.col("content")) >= 1).alias("measured"))


def regulation_prefix(special: str = "special", permit: str = "permit", exam: str = "exam", measured: str = "measured") -> Column:
    return F.when(F.col(special), "[특별]").when(F.col(permit), "[허가]").when(F.col(exam) & ~F.col(measured), "[특검]").otherwise("")


_PREFIX = "CASE WHEN special THEN '[특별]' WHEN permit THEN '[허가]' WHEN exam AND NOT measured THEN '[특검]' ELSE '' END"


@query("scl13_prefix", f"SELECT ord, {_PREFIX} AS prefix FROM master")
def prefix(t: Tables) -> DataFrame:
    return t.master.select("ord", regulation_prefix().alias("prefix"))


@query("scl14_labels", f"SELECT ord, {_PREFIX} || name || '[' || cas || '(' || twa || ')]' AS full_label, {_PREFIX} || name || '(' || twa || ')' AS short_label, '[' || cas || ']' || {_PREFIX} || name || '(' || twa || ')' AS led_label FROM master")
def labels(t: Tables) -> DataFrame:
    p, o, c = regulation_prefix(), F.lit("("), F.lit(")")
    return t.master.select(
        "ord", F.concat(p, "name", F.lit("["), "cas", o, "twa", F.lit(")]")).alias("full_label"), F.concat(p, "name", o, "twa", c).alias("short_label"),
        F.concat(F.lit("["), "cas", F.lit("]"), p, "name", o, "twa", c).alias("led_label"),
    )


_FACTORS = D.values_sql("f", "n, cas, word, factor", tuple((i, c, w, one) for i, (c, w, one, _) in enumerate(D.FACTORS)))


@query("scl15_factor_override", f"""
WITH {_FACTORS}, h AS (SELECT c.doc_id, c.seq, min_by(f.factor, f.n) AS factor FROM chemical c JOIN f ON c.cas = f.cas OR (contains(lower(c.name), f.word) AND f.n < 3) GROUP BY ALL)
SELECT c.doc_id, c.seq, CASE WHEN contains(c.flags, '광물성분진') THEN '기타광물성분진' ELSE coalesce(h.factor, c.name) END AS factor FROM chemical c LEFT JOIN h USING (doc_id, seq)""")
def factor_override(t: Tables) -> DataFrame:
    """Mineral dust in the regulation's text first, then the table of overrides in order: by number, or by a word of the name."""
    low = F.lower("name")
    found = F.coalesce(
        F.when(F.contains("flags", F.lit(D.MINERAL_DUST)), D.MINERAL_DUST_FACTOR),
        *(F.when((F.col("cas") == cas) | (F.contains(low, F.lit(word)) if n < 3 else F.lit(False)), one) for n, (cas, word, one, _) in enumerate(D.FACTORS)), "name",
    )
    return t.chemical.select("doc_id", "seq", found.alias("factor"))


@query("scl15_factor_list", f"""
WITH {D.values_sql("f", "n, cas, word", tuple((i, c, w) for i, (c, w, _, _) in enumerate(D.FACTORS)))}, {D.values_sql("l", "n, i, factor", tuple((n, i, x) for n, f in enumerate(D.FACTORS) for i, x in enumerate(f[3])))},
h AS (SELECT c.doc_id, c.seq, min(f.n) AS n FROM chemical c JOIN f ON c.cas = f.cas OR contains(lower(regexp_replace(c.name, '\\s', '', 'g')), f.word) GROUP BY ALL)
SELECT c.doc_id, c.seq, coalesce(l.i, 0) AS i, coalesce(l.factor, c.name) AS factor FROM chemical c LEFT JOIN h USING (doc_id, seq) LEFT JOIN l ON l.n = h.n""")
def factor_list(t: Tables) -> DataFrame:
    """The list form of the overrides, a row for each factor; without one the name itself."""
    bare = F.lower(F.regexp_replace("name", r"\s", ""))
    found = F.coalesce(*(F.when((F.col("cas") == cas) | F.contains(bare, F.lit(word)), F.array(*map(F.lit, many))) for cas, word, _, many in D.FACTORS), F.array("name"))
    return t.chemical.select("doc_id", "seq", F.posexplode(found).alias("i", "factor"))


_WELDS = "(contains({0}, '용접') OR contains(lower({0}), 'welding'))"


def welds(product: Column) -> Column:
    return F.contains(product, F.lit(D.WELDING_WORDS[0])) | F.contains(F.lower(product), F.lit(D.WELDING_WORDS[1]))


@query("scl16_welding", f"""
WITH n AS (SELECT doc_id, max(content) FILTER (WHERE cas = '7439-89-6') AS iron, coalesce(string_agg(name, '; ' ORDER BY seq) FILTER (WHERE cas NOT IN ('7439-89-6', '')), '') AS subjects FROM chemical GROUP BY doc_id)
SELECT g.doc_id, CASE WHEN {_WELDS.format("product")} AND iron IS NOT NULL THEN CASE WHEN subjects = '' THEN '용접흄; 산화철(분진, 흄)' ELSE '용접흄; 산화철(분진, 흄); ' || subjects END ELSE subjects END AS work_subjects,
    CASE WHEN {_WELDS.format("product")} AND iron IS NOT NULL THEN '철(' || iron || ')' ELSE '' END AS second FROM goods g JOIN n USING (doc_id)""")
def welding(t: Tables) -> DataFrame:
    """A welding product that holds iron: fume and oxide come before the measured subjects, iron with its content into the second list."""
    own = F.array_sort(F.collect_list(F.when(~F.col("cas").isin(D.IRON, ""), F.struct("seq", "name"))))
    n = t.chemical.groupBy("doc_id").agg(F.max(F.when(F.col("cas") == D.IRON, F.col("content"))).alias("iron"), F.array_join(F.transform(own, lambda x: x["name"]), "; ").alias("subjects"))
    hit = welds(F.col("product")) & F.col("iron").isNotNull()
    subjects = F.when(hit, F.concat_ws("; ", F.lit(D.WELDING_SUBJECTS), F.nullif("subjects", F.lit("")))).otherwise(F.col("subjects"))
    second = F.when(hit, F.concat(F.lit(D.IRON_NAME + "("), "iron", F.lit(")"))).otherwise("")
    return t.goods.join(n, "doc_id").select("doc_id", subjects.alias("work_subjects"), second.alias("second"))


@query("scl17_welding_rows", f"""
WITH w AS (SELECT g.doc_id, {_WELDS.format("product")} AS welds, contains(upper(regexp_replace(product, '[\\s\\-_()]', '', 'g')), 'CR13') AND {_WELDS.format("product")} AS fixed FROM goods g),
{D.values_sql("d", "word", tuple((x,) for x in D.DUST_WORDS))}, {D.values_sql("fixed_rows", "cas, name, content", D.FIXED_PRODUCT)},
c AS (SELECT w.doc_id, w.welds, CASE WHEN welds AND (cas = '7439-89-6' OR name = '철') THEN '1309-37-1' ELSE cas END AS cas, CASE WHEN welds AND (cas = '7439-89-6' OR name = '철') THEN '산화철(분진, 흄)' ELSE name END AS name, content,
    NOT (cas = '7439-89-6' OR name = '철') AND (cas IN ('1317-65-3', '471-34-1', '14807-96-6', '68476-25-5') OR EXISTS (SELECT 1 FROM d WHERE contains(lower(c.name), d.word))) AS dust FROM chemical c JOIN w USING (doc_id) WHERE NOT fixed),
k AS (SELECT doc_id, cas, name, content, welds FROM c WHERE NOT (welds AND dust)),
docs AS (SELECT DISTINCT doc_id FROM c WHERE welds), have AS (SELECT doc_id, bool_or(cas = '용접흄' OR name = '용접흄') AS fume, bool_or(cas = '1309-37-1' OR contains(name, '산화철')) AS oxide FROM k GROUP BY doc_id)
SELECT doc_id, cas, name, content FROM k
UNION ALL SELECT doc_id, '용접흄', '용접흄', 'Rem.%' FROM docs LEFT JOIN have USING (doc_id) WHERE fume IS NOT TRUE
UNION ALL SELECT doc_id, '1309-37-1', '산화철(분진, 흄)', 'Rem.%' FROM docs LEFT JOIN have USING (doc_id) WHERE oxide IS NOT TRUE
UNION ALL SELECT doc_id, cas, name, content FROM (SELECT DISTINCT doc_id FROM chemical JOIN w USING (doc_id) WHERE fixed), fixed_rows""")
def welding_rows(t: Tables) -> DataFrame:
    """In welding, iron becomes its oxide, mineral dust goes, fume and oxide come where they lack; one product has fixed components."""
    bare = F.upper(F.regexp_replace("product", r"[\s\-_()]", ""))
    sheet = t.goods.select("doc_id", welds(F.col("product")).alias("welds"), (F.contains(bare, F.lit("CR13")) & welds(F.col("product"))).alias("fixed"))
    rows = t.chemical.join(sheet, "doc_id")
    iron = (F.col("cas") == D.IRON) | (F.col("name") == D.IRON_NAME)
    dust = ~iron & (F.col("cas").isin(*D.DUST_NUMBERS) | F.exists(F.array(*map(F.lit, D.DUST_WORDS)), lambda w: F.contains(F.lower("name"), w)))
    turned = F.col("welds") & iron
    free = rows.where(~F.col("fixed"))
    kept = free.where(~(F.col("welds") & dust)).select("doc_id", "welds", F.when(turned, D.IRON_OXIDE).otherwise(F.col("cas")).alias("cas"), F.when(turned, D.IRON_OXIDE_NAME).otherwise(F.col("name")).alias("name"), "content")
    # What a welding document lacks, counted over all of its rows, dropped ones too.
    oxide = (turned | (~dust & ((F.col("cas") == D.IRON_OXIDE) | F.contains("name", F.lit("산화철"))))).alias("oxide")
    fume = (~dust & ((F.col("cas") == D.FUME) | (F.col("name") == D.FUME))).alias("fume")
    lacks = free.where("welds").select("doc_id", oxide, fume).groupBy("doc_id").agg(F.bool_or("oxide").alias("oxide"), F.bool_or("fume").alias("fume"))
    row = lambda cas, name: F.struct(F.lit(cas).alias("cas"), F.lit(name).alias("name"), F.lit("Rem.%").alias("content"))
    added = lacks.select("doc_id", F.explode(F.array_compact(F.array(F.when(~F.col("fume"), row(D.FUME, D.FUME)), F.when(~F.col("oxide"), row(D.IRON_OXIDE, D.IRON_OXIDE_NAME))))).alias("x")).select("doc_id", "x.*")
    fixed = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(x, ("cas", "name", "content"), strict=True))) for x in D.FIXED_PRODUCT))
    given = rows.where("fixed").select("doc_id").distinct().select("doc_id", F.explode(fixed).alias("x")).select("doc_id", "x.*")
    return kept.drop("welds").unionByName(added).unionByName(given)


@query("scl18_product_exception", f"""
WITH {D.values_sql("e", "n, product, targets, components", tuple((n, x[1], x[2], x[3]) for n, x in enumerate(D.EXCEPTIONS)))}, {D.values_sql("w", "n, word", tuple((n, w) for n, x in enumerate(D.EXCEPTIONS) for w in x[0]))},
p AS (SELECT doc_id, upper(regexp_replace(product, '[ -]', '', 'g')) AS pool FROM goods),
h AS (SELECT doc_id, n FROM p, w GROUP BY doc_id, pool, n HAVING bool_and(contains(pool, upper(regexp_replace(word, '[ -]', '', 'g')))))
SELECT g.doc_id, coalesce(e.product, g.product) AS product, e.targets, e.components FROM goods g LEFT JOIN h USING (doc_id) LEFT JOIN e ON e.n = h.n""")
def product_exception(t: Tables) -> DataFrame:
    """A product that holds all words of an entry, spaces and hyphens aside, has the entry's name, targets and components."""
    pool = F.upper(F.regexp_replace("product", "[ -]", ""))
    bare = [w.upper().replace(" ", "").replace("-", "") for words, *_ in D.EXCEPTIONS for w in words]
    whole, at = [], 0
    for words, *entry in D.EXCEPTIONS:
        hit = F.lit(True)
        for w in bare[at : at + len(words)]:
            hit = hit & F.contains(pool, F.lit(w))
        at += len(words)
        whole.append((hit, entry))
    pick = lambda i, last: F.coalesce(*(F.when(hit, entry[i]) for hit, entry in whole), last)
    none = F.lit(None).cast("string")
    return t.goods.select("doc_id", pick(0, F.col("product")).alias("product"), pick(1, none).alias("targets"), pick(2, none).alias("components"))


_INTEGRITY = f"SELECT d.doc_id, d.product_seen, any_value(c.x) IS NOT NULL AND bool_or(NOT c.x) AS bad FROM document d LEFT JOIN (SELECT doc_id, {_CHECK} AS x FROM component) c USING (doc_id) GROUP BY ALL"


@query("scl19_integrity", f"WITH i AS ({_INTEGRITY}) SELECT doc_id, 100 - CASE WHEN product_seen = '' THEN 10 ELSE 0 END - CASE WHEN coalesce(bad, false) THEN 60 ELSE 0 END AS score, concat_ws(' ', CASE WHEN product_seen = '' THEN '[no product]' END, CASE WHEN coalesce(bad, false) THEN '[invalid number]' END) AS reason FROM i")
def integrity(t: Tables) -> DataFrame:
    return integrity_of(t).select("doc_id", "score", "reason")


def integrity_of(t: Tables) -> DataFrame:
    bad = t.component.select("doc_id", (~C.checksum_holds(F.col("cas"))).alias("bad")).groupBy("doc_id").agg(F.bool_or("bad").alias("bad"))
    rows = t.document.join(bad, "doc_id", "left").withColumns({"bad": F.coalesce("bad", F.lit(False)), "bare": F.col("product_seen") == ""})
    score = 100 - 10 * F.col("bare").cast("int") - 60 * F.col("bad").cast("int")
    reason = F.concat_ws(" ", F.when(F.col("bare"), "[no product]"), F.when(F.col("bad"), "[invalid number]"))
    return rows.select("doc_id", score.alias("score"), reason.alias("reason"), "bad", "bare", "status")


@query("scl20_traffic_light", f"WITH i AS ({_INTEGRITY}) SELECT i.doc_id, CASE WHEN d.status = 'failed' THEN '🔴' WHEN d.status = 'timeout' THEN '🟣' WHEN coalesce(bad, false) OR i.product_seen = '' THEN '🟡' ELSE '🟢' END AS light FROM i JOIN document d USING (doc_id)")
def traffic_light(t: Tables) -> DataFrame:
    light = F.when(F.col("status") == "failed", "🔴").when(F.col("status") == "timeout", "🟣").when(F.col("bad") | F.col("bare"), "🟡").otherwise("🟢")
    return integrity_of(t).select("doc_id", light.alias("light"))


_PUNCTUATION = r"""[\s\-‐‑‒–—―()\[\]{}<>〈〉《》【】'"`·•_,.:;/\\]+"""


def _bare_sql(expression: str) -> str:
    return f"regexp_replace(lower({expression}), '" + _PUNCTUATION.replace("'", "''") + "', '', 'g')"


@query("scl21_product_match", f"""
WITH x AS (SELECT doc_id, {_bare_sql(fold_sql("seen"))} AS a, {_bare_sql(fold_sql("product"))} AS b FROM goods)
SELECT doc_id, CASE WHEN a = '' THEN 'missing' WHEN b = '' THEN 'unverified' WHEN a = b OR ((contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) * 100 >= 75 * greatest(length(a), length(b))) THEN 'match' ELSE 'mismatch' END AS status,
    CASE WHEN a <> '' AND b <> '' AND (a = b OR ((contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) * 100 >= 75 * greatest(length(a), length(b)))) THEN 'verified' ELSE 'review' END AS verdict FROM x""")
def product_match(t: Tables) -> DataFrame:
    """The name found against the local candidate: equal, or one within the other at three quarters of its length."""
    a, b = (F.regexp_replace(F.lower(fold(F.col(c))), _PUNCTUATION, "") for c in ("seen", "product"))
    close = F.least(F.length(a), F.length(b)) * 100 >= 75 * F.greatest(F.length(a), F.length(b))
    same = (a == b) | ((F.contains(a, b) | F.contains(b, a)) & close)
    status = F.when(a == "", "missing").when(b == "", "unverified").when(same, "match").otherwise("mismatch")
    return t.goods.select("doc_id", status.alias("status"), F.when(status == "match", "verified").otherwise("review").alias("verdict"))


#: Labels of a product's name, and words that show that another field was met.
PRODUCT_LABELS = r"(?:Name\s+of\s+product|Product\s+(?:name|identity)|제품명|상품명|품명)"
NO_PRODUCT = r"\b(?:Company|Manufacturer|Supplier|Intended\s+Use|용도|제조자|공급자)\b"
_LABELLED = r"(?i)^\s*(?:(?:[0-9]+(?:\.[0-9]+)*\.?|[a-z]\.)\s*)?" + PRODUCT_LABELS + r"\s*(?:[:：\-]\s*)?(.+?)\s*$"


@query("scl22_labelled_product", f"""
WITH s AS (SELECT doc_id, ord, CASE ord % 4 WHEN 0 THEN '1.1 Product name : ' WHEN 1 THEN 'a. 제품명 ' WHEN 2 THEN 'Name of product - Supplier x' || chr(10) || '상품명: ' ELSE '1. Intended Use of product ' END || product || ' 1.2.1 use' AS sheet FROM goods),
l AS (SELECT doc_id, i, {fold_sql("line")} AS line FROM (SELECT doc_id, unnest(string_split('Section 1' || chr(10) || sheet, chr(10))) AS line, unnest(range(100)[1:len(string_split(sheet, chr(10))) + 1]) AS i FROM s)),
c AS (SELECT doc_id, i, trim(regexp_replace(trim(regexp_extract(trim(line), '{_LABELLED}', 1), ' :：-' || chr(9)), '\\s+[0-9]+(?:\\.[0-9]+)+\\.?\\s.*$', '')) AS name FROM l)
SELECT s.doc_id, coalesce(min_by(c.name, c.i), '') AS found FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND length(c.name) BETWEEN 2 AND 99 AND NOT regexp_matches(c.name, '(?i)Company|Manufacturer|Supplier|Intended\\s+Use|용도|제조자|공급자') GROUP BY s.doc_id""")
def labelled_product(t: Tables) -> DataFrame:
    """The value of the first line with a label, cut before the next numbered heading; a line of another field does not count."""
    lead = F.when(F.col("ord") % 4 == 0, "1.1 Product name : ").when(F.col("ord") % 4 == 1, "a. 제품명 ").when(F.col("ord") % 4 == 2, "Name of product - Supplier x\n상품명: ").otherwise("1. Intended Use of product ")
    sheet = F.concat(F.lit("Section 1\n"), lead, "product", F.lit(" 1.2.1 use"))
    cut = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(s), _LABELLED, 1), r"^[ \t:：-]+|[ \t:：-]+$", ""), r"\s+[0-9]+(?:\.[0-9]+)+\.?\s.*$", ""))
    names = F.filter(F.transform(F.split(fold(sheet), "\n"), cut), lambda n: F.length(n).between(2, 99) & ~n.rlike("(?iU)" + NO_PRODUCT))
    return t.goods.select("doc_id", F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("found"))


#: Labels that are cut off before a candidate.
CANDIDATE_LABELS = ("제품\\s*명", "물질\\s*명", "상호명", "품명", "용도", "사용")


@query("scl23_clean_candidate", f"SELECT doc_id, CASE WHEN ord % 6 = 4 THEN '용도:' ELSE '' END || {fold_sql('product')} AS clean FROM goods")
def clean_candidate(t: Tables) -> DataFrame:
    """Labels before a name go, then signs and spaces before it; a label behind signs stays."""
    labels = ("제품 명 : ", "물질명：", "상호명:", "품명: 용도 : ", "·- 용도:", "【(>. ")
    raw = F.concat(F.get(F.array(*map(F.lit, labels)), (F.col("ord") % len(labels)).cast("int")), "product")
    bare = fold(raw)
    for label in CANDIDATE_LABELS:
        bare = F.regexp_replace(bare, rf"(?i)^{label}\s*[:：]\s*", "")
    bare = F.regexp_replace(bare, r"^[ \t:：·\-\.\s()>【】\[\]]+", "")
    return t.goods.select("doc_id", F.trim(bare).alias("clean"))


@query("scl24_formula_mask", "SELECT doc_id, seq, 'mix * at ' || content AS masked FROM component")
def formula_mask(t: Tables) -> DataFrame:
    """Chemical formulas are masked so that their digits are no amounts."""
    line = F.concat(F.lit("mix C2H6O at "), "content")
    return t.component.select("doc_id", "seq", F.regexp_replace(line, r"\b(?:[A-Z][a-z]?[0-9]+){1,}(?:[A-Z][a-z]?[0-9]*)*\b", "*").alias("masked"))


@query("scl25_token_mask", "SELECT doc_id, seq, 'grade AXXB ' || cas || ' ' || CAST(quantity AS STRING) || '% <5' AS masked FROM component")
def token_mask(t: Tables) -> DataFrame:
    """Digits inside tokens of letters and digits become X; registry numbers and amounts stay."""
    line = F.concat(F.lit("grade A12B "), "cas", F.lit(" "), F.col("quantity").cast("string"), F.lit("% <5"))
    mixed = lambda w: w.rlike("[A-Za-z]") & w.rlike("[0-9]") & ~w.rlike(C.SHAPE)
    words = F.transform(F.split(line, " "), lambda w: F.when(mixed(w), F.regexp_replace(w, "[0-9]", "X")).otherwise(w))
    return t.component.select("doc_id", "seq", F.array_join(words, " ").alias("masked"))


@query("scl26_natural_key", "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(file_name, '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 20, '0') ELSE lower(p) END), '') AS key FROM document")
def natural_keys(t: Tables) -> DataFrame:
    return t.document.select("doc_id", natural_key(F.col("file_name")).alias("key"))


@query("scl27_digit_repair", "SELECT doc_id, seq, cas AS repaired FROM component")
def digit_repair(t: Tables) -> DataFrame:
    misread = F.translate("cas", "015", "oiS")
    return t.component.select("doc_id", "seq", F.translate(misread, "oOiIlsS", "0011155").alias("repaired"))


@query("scl28_digit_key", "SELECT doc_id, seq, replace(cas, '-', '') AS digits FROM component")
def digit_key(t: Tables) -> DataFrame:
    return t.component.select("doc_id", "seq", C.digits(F.col("cas")).alias("digits"))


@query("scl29_name_forms", r"""
SELECT ord, lower(regexp_replace(name, '[\s\-_·,./()\[\]{}]', '', 'g')) AS a, lower(regexp_replace(name, '[^0-9a-zA-Z가-힣]', '', 'g')) AS b, lower(regexp_replace(name, '\s', '', 'g')) AS c, regexp_replace(replace(replace(lower(name), '™', ''), 'tm', ''), '[^0-9a-z가-힣]', '', 'g') AS d FROM master""")
def name_forms(t: Tables) -> DataFrame:
    """Four normal forms that different callers use; they are kept apart on purpose."""
    n = F.col("name")
    return t.master.select(
        "ord", F.lower(F.regexp_replace(n, r"[\s\-_·,./()\[\]{}]", "")).alias("a"), F.lower(F.regexp_replace(n, "[^0-9a-zA-Z가-힣]", "")).alias("b"),
        F.lower(F.regexp_replace(n, r"\s", "")).alias("c"), F.regexp_replace(F.regexp_replace(F.lower(n), "™|tm", ""), "[^0-9a-z가-힣]", "").alias("d"),
    )


@query("scl30_cas_from_text", "SELECT doc_id, seq, cas AS without_spaces, CASE WHEN seq % 2 = 0 THEN cas ELSE '' END AS as_written FROM component")
def cas_from_text(t: Tables) -> DataFrame:
    line = F.concat(F.lit("no. "), F.when(F.col("seq") % 2 == 0, F.col("cas")).otherwise(F.replace("cas", F.lit("-"), F.lit(" - "))), F.lit(" x"))
    found = lambda s: F.regexp_extract(s, C.TOKEN, 1)
    return t.component.select("doc_id", "seq", found(F.replace(line, F.lit(" "), F.lit(""))).alias("without_spaces"), found(line).alias("as_written"))


@query("scl31_base_name", "SELECT ord, coalesce(nullif(trim(split_part(name, '(', 1)), ''), name) AS base FROM master")
def base_name(t: Tables) -> DataFrame:
    return t.master.select("ord", F.coalesce(F.nullif(F.trim(F.regexp_replace("name", "[(（].*$", "")), F.lit("")), "name").alias("base"))


@query("scl32_display_names", r"""
SELECT doc_id, seq, trim(regexp_replace(name, '\s*\([a-zA-Z\s,]+\)', '', 'g')) AS no_english,
    CASE WHEN regexp_full_match(trim(name), '[가-힣\s\d\w,./-]+\s*\([A-Za-z\s\d,]+\)') THEN trim(regexp_replace(trim(name), '\s*\([A-Za-z\s\d,]+\)$', '')) ELSE trim(name) END AS korean,
    CASE WHEN regexp_matches(name, '[가-힣]') THEN trim(regexp_replace(name, '\s*\([A-Za-z\s\d,]+\)$', '')) ELSE trim(name) END AS shown, trim(regexp_replace(name || ' (Twa)', '(?i)\s*\((?:STEL|TWA|PEL|TLV)\)', '', 'g')) AS unit_free
FROM chemical""")
def display_names(t: Tables) -> DataFrame:
    """Four forms: without English parentheses anywhere; without one behind a Korean or plain name; without one behind a name in Hangul; without a limit's unit."""
    n, tail = F.trim("name"), r"\s*\([A-Za-z\s0-9,]+\)$"
    cut = F.trim(F.regexp_replace(n, tail, ""))
    whole = n.rlike(r"(?U)^[가-힣\s\d\w,./-]+\s*\([A-Za-z\s0-9,]+\)$")
    return t.chemical.select(
        "doc_id", "seq", F.trim(F.regexp_replace("name", r"\s*\([a-zA-Z\s,]+\)", "")).alias("no_english"), F.when(whole, cut).otherwise(n).alias("korean"),
        F.when(n.rlike("[가-힣]"), cut).otherwise(n).alias("shown"), F.trim(F.regexp_replace(F.concat("name", F.lit(" (Twa)")), r"(?i)\s*\((?:STEL|TWA|PEL|TLV)\)", "")).alias("unit_free"),
    )


def pure_substance(item: Column) -> Column:
    """Parentheses, a category before the name, tags and brackets off."""
    text = F.trim(F.regexp_replace(item, r"\([^()]*\)", ""))
    for prefix in D.ITEM_PREFIXES:
        text = F.when(F.startswith(text, F.lit(prefix)), F.trim(F.substr(text, F.lit(len(prefix) + 1)))).otherwise(text)
    return F.trim(F.translate(F.trim(F.regexp_replace(text, r"\[특별\]|\[특검\]|\[허가\]", "")), "[]", ""))


def core_name(name: Column) -> Column:
    """Endings off, the longest first."""
    for suffix in sorted(D.CORE_SUFFIXES, key=len, reverse=True):
        name = F.replace(name, F.lit(suffix), F.lit(""))
    return F.trim(name)


def _core_sql(name: str) -> str:
    for suffix in sorted(D.CORE_SUFFIXES, key=len, reverse=True):
        name = f"replace({name}, '{suffix}', '')"
    return f"trim({name})"


@query("scl33_pure_name", f"SELECT doc_id, seq, trim(replace(replace(regexp_replace(name, '\\([^()]*\\)', '', 'g'), '[', ''), ']', '')) AS pure, {_core_sql('name')} AS core FROM chemical")
def pure_name(t: Tables) -> DataFrame:
    tags = F.array(*map(F.lit, (*D.ITEM_PREFIXES, "")))
    item = F.concat(F.get(tags, (F.col("quantity") % 5).cast("int")), F.when(F.col("quantity") % 2 == 0, " [특별]").otherwise(" ["), "name", F.lit("] (5~10%)"))
    return t.chemical.select("doc_id", "seq", pure_substance(item).alias("pure"), core_name(F.col("name")).alias("core"))


def sort_code_parts(code: Column) -> Column:
    """category_order, sort_group, sort_order; a code of another shape goes last."""
    ok = code.rlike(r"^[0-9][A-Z]-[0-9]{2}-[0-9]{3}$")
    return F.struct(
        F.when(ok, F.substring(code, 1, 1).try_cast("int")).otherwise(999).alias("category_order"),
        F.when(ok, F.substring(code, 1, 5)).otherwise(F.coalesce(F.nullif(code, F.lit("")), F.lit("ZZZ"))).alias("sort_group"),
        F.when(ok, F.substring(code, 7, 3).try_cast("int")).otherwise(999999).alias("sort_order"),
    )


@query("scl34_sort_code", """
WITH k AS (SELECT ord, CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN 'odd' ELSE sort_code END AS code FROM master), p AS (SELECT *, regexp_matches(code, '^[0-9][A-Z]-[0-9]{2}-[0-9]{3}$') AS ok FROM k)
SELECT ord, CASE WHEN ok THEN CAST(code[1] AS INTEGER) ELSE 999 END AS category_order, CASE WHEN ok THEN substr(code, 1, 5) ELSE coalesce(nullif(code, ''), 'ZZZ') END AS sort_group, CASE WHEN ok THEN CAST(substr(code, 7, 3) AS INTEGER) ELSE 999999 END AS sort_order FROM p""")
def sort_code(t: Tables) -> DataFrame:
    code = F.when(F.col("ord") % 5 == 0, "").when(F.col("ord") % 5 == 1, "odd").otherwise(F.col("sort_code"))
    return t.master.select("ord", sort_code_parts(code).alias("x")).select("ord", "x.*")


#: Decision, whether the profile is active, selectable, default.
DECISIONS = (("승인", True, True, True), ("수정", True, True, False), ("보류", False, False, False), ("제외", False, False, False), ("추가검토", True, False, False))


@query("scl35_decision_state", """
WITH d(decision, is_active, selectable, is_default) AS (VALUES ('승인', true, true, true), ('수정', true, true, false), ('보류', false, false, false), ('제외', false, false, false), ('추가검토', true, false, false))
SELECT m.ord, d.is_active, d.selectable, d.is_default FROM master m JOIN d USING (decision)""")
def decision_state(t: Tables) -> DataFrame:
    d = t.spark.createDataFrame(DECISIONS, "decision string, is_active boolean, selectable boolean, is_default boolean")
    return t.master.join(F.broadcast(d), "decision").select("ord", "is_active", "selectable", "is_default")


@query("scl36_review_status", """
WITH r AS (SELECT ord, decision, CASE WHEN ord % 4 = 0 THEN NULL ELSE 'Y' END AS policy, ord % 6 = 0 AS unresolved FROM master)
SELECT ord, CASE WHEN decision IN ('승인', '수정') AND policy IS NOT NULL THEN 'approved' WHEN decision = '제외' THEN 'excluded' ELSE 'review' END AS review_status, decision IN ('승인', '수정') AND policy IS NOT NULL AND NOT unresolved AS active FROM r""")
def review_status(t: Tables) -> DataFrame:
    approved = F.col("decision").isin("승인", "수정") & (F.col("ord") % 4 != 0)
    status = F.when(approved, "approved").when(F.col("decision") == "제외", "excluded").otherwise("review")
    return t.master.select("ord", status.alias("review_status"), (approved & (F.col("ord") % 6 != 0)).alias("active"))


@query("scl37_target_amendment", "SELECT ord, CASE WHEN decision = '수정' THEN 'new ' || CAST(ord AS STRING) ELSE name END AS target FROM master")
def target_amendment(t: Tables) -> DataFrame:
    note = F.concat(F.lit("참고; 추천인자: new "), F.col("ord").cast("string"), F.lit("; 끝"))
    named = F.trim(F.regexp_extract(note, "추천인자\\s*:\\s*([^;]+)", 1))
    return t.master.select("ord", F.when((F.col("decision") == "수정") & (named != ""), named).otherwise(F.col("name")).alias("target"))


def uuid5(name: Column, namespace: str) -> Column:
    """The hex digits, in capitals, of a name-based id (RFC 9562, version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.upper(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def _uuid5_sql(name: str, namespace: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"upper(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h}, 17, 1)), 1) || substr({h}, 18, 15))"


def source_row_id(*identity: Column | str) -> Column:
    """Of kind, version, sheet, sort code, name, raw number and review key."""
    return F.concat(F.lit("SRC_"), uuid5(F.concat_ws("|", *identity), D.PROFILE_NAMESPACE))


def profile_id(source: Column) -> Column:
    return F.concat(F.lit("SP_"), uuid5(source, D.PROFILE_NAMESPACE))


_SOURCE_ID = "'SRC_' || " + _uuid5_sql("concat_ws('|', 'master', 'V24', 'sheet', sort_code, name, cas, '')", D.PROFILE_NAMESPACE)


@query("scl38_uuid5", f"""
WITH s AS (SELECT ord, {_SOURCE_ID} AS source_row_id FROM master), p AS (SELECT *, 'SP_' || {_uuid5_sql("source_row_id", D.PROFILE_NAMESPACE)} AS profile_id FROM s)
SELECT *, 'REL_' || {_uuid5_sql("concat_ws('|', profile_id, profile_id, 'SAME', CAST(ord AS STRING))", D.RELATION_NAMESPACE)} AS relation_id, 'RULE_' || {_uuid5_sql("CAST(ord AS STRING)", D.RULE_NAMESPACE)} AS rule_id FROM p""")
def uuid5_ids(t: Tables) -> DataFrame:
    source = source_row_id(F.lit("master"), F.lit("V24"), F.lit("sheet"), "sort_code", "name", "cas", F.lit(""))
    rows = t.master.select("ord", source.alias("source_row_id")).withColumn("profile_id", profile_id(F.col("source_row_id")))
    relation = uuid5(F.concat_ws("|", "profile_id", "profile_id", F.lit("SAME"), F.col("ord").cast("string")), D.RELATION_NAMESPACE)
    return rows.withColumns({"relation_id": F.concat(F.lit("REL_"), relation), "rule_id": F.concat(F.lit("RULE_"), uuid5(F.col("ord").cast("string"), D.RULE_NAMESPACE))})


@query("scl39_exposure_text", """
SELECT ord, CASE WHEN twa = '-' OR ord % 4 = 3 THEN '-' ELSE twa END AS twa_ppm, CASE WHEN ord % 4 = 0 THEN '12.5' ELSE '-' END AS twa_mg, CASE WHEN ord % 4 = 1 THEN '7' ELSE '-' END AS stel_ppm, CASE WHEN ord % 4 = 3 THEN '-' ELSE CAST(ord % 30 AS STRING) END AS stel_mg FROM master""")
def exposure_text(t: Tables) -> DataFrame:
    """Two limits in two units, read from one text; what it does not state is a dash."""
    n = F.col("ord") % 4
    text = F.when(n == 3, "국내규정 없음").otherwise(F.concat(
        F.lit("twa ："), "twa", F.lit(" PPM; "), F.when(n == 0, "TWA 12.5 ㎎/㎥, ").otherwise(""), F.when(n == 1, "STEL: 7 ppm ").otherwise(""), F.lit("STEL : "), (F.col("ord") % 30).cast("string"), F.lit(" ㎎/㎥"),
    ))
    read = lambda name, unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(?i){name}\s*[:：]?\s*([0-9]+(?:\.[0-9]+)?)\s*{unit}", 1), F.lit("")), F.lit("-"))
    return t.master.select("ord", read("TWA", "ppm").alias("twa_ppm"), read("TWA", "㎎/㎥").alias("twa_mg"), read("STEL", "ppm").alias("stel_ppm"), read("STEL", "㎎/㎥").alias("stel_mg"))


@query("scl40_regulation_flags", "SELECT doc_id, seq, " + ", ".join(f"contains(flags, '{w}') AS {c}" for c, w in D.OSH_FLAGS) + ", " + ", ".join(f"contains(flags, '{w}') AS cca_{c}" for c, w in D.CCA_FLAGS) + ", '' AS cca_ecology FROM chemical")
def regulation_flags(t: Tables) -> DataFrame:
    """Six flags of one law and five of the other by words of the text; a further field of the other stays empty."""
    has = lambda w: F.contains("flags", F.lit(w))
    return t.chemical.select("doc_id", "seq", *(has(w).alias(c) for c, w in D.OSH_FLAGS), *(has(w).alias(f"cca_{c}") for c, w in D.CCA_FLAGS), F.lit("").alias("cca_ecology"))


@query("scl41_limit_number", "SELECT ord, TRY_CAST(twa AS DOUBLE) AS twa FROM master WHERE TRY_CAST(twa AS DOUBLE) > 0")
def limit_number(t: Tables) -> DataFrame:
    """A lone point is no number."""
    found = F.regexp_extract(F.concat(F.lit("약 "), "twa", F.lit(" .")), r"[0-9.]+", 0).try_cast("double")
    return t.master.select("ord", found.alias("twa")).where("twa > 0")


def file_trace_id(run: Column, file: Column) -> Column:
    """A run and a file (its hash, or else its path), kept apart by a character that neither holds."""
    return F.substring(F.sha2(F.concat(run, F.lit("\0"), file), 256), 1, 24)


@query("scl42_trace_id", r"SELECT seq, substr(sha256(encode(CAST(run_id AS STRING)) || '\x00'::BLOB || encode(CAST(trace_id AS STRING))), 1, 24) AS file_trace_id FROM journal")
def trace_id(t: Tables) -> DataFrame:
    return t.journal.select("seq", file_trace_id(F.col("run_id").cast("string"), F.col("trace_id").cast("string")).alias("file_trace_id"))


def safe_export_name(file: Column, trace: Column, most: int = 80) -> Column:
    """A file's name without what folders and extensions need, cut so that two underscores and the head of its trace id fit."""
    raw = F.regexp_replace(F.coalesce(F.nullif(file, F.lit("")), F.lit("diagnostic")), r"[<>:\"/\\|?*\x00-\x1f]+", "_")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\.[A-Za-z0-9]{1,8}$", ""), r"\s+", "_"), r"^[ ._]+|[ ._]+$", "")
    suffix = F.coalesce(F.nullif(F.substring(F.regexp_replace(trace, "[^A-Za-z0-9]", ""), 1, 8), F.lit("")), F.lit("unknown"))
    room = F.greatest(F.lit(8), F.lit(most) - F.length(suffix) - 2)
    return F.concat(F.substr(F.coalesce(F.nullif(stem, F.lit("")), F.lit("diagnostic")), F.lit(1), room), F.lit("__"), suffix)


_FILE = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('long name ', 12) || file_name WHEN 2 THEN '..a<b>:c' || chr(9) || file_name ELSE file_name END"
_TRACE = "CASE doc_id % 3 WHEN 0 THEN '-_' WHEN 1 THEN 'ab-12' ELSE file_hash || '-xyz-123456789' END"


@query("scl43_safe_name", rf"""
WITH f AS (SELECT doc_id, {_FILE} AS file, {_TRACE} AS trace FROM document),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(file, ''), 'diagnostic'), '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '\.[A-Za-z0-9]{{1,8}}$', ''), '\s+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS stem, coalesce(nullif(substr(regexp_replace(trace, '[^A-Za-z0-9]', '', 'g'), 1, 8), ''), 'unknown') AS suffix FROM f)
SELECT doc_id, substr(coalesce(nullif(stem, ''), 'diagnostic'), 1, greatest(8, 80 - length(suffix) - 2)::BIGINT) || '__' || suffix AS safe FROM s""")
def safe_name(t: Tables) -> DataFrame:
    return t.document.select("doc_id", safe_export_name(F.expr(_FILE), F.expr(_TRACE)).alias("safe"))


def redact(text: Column) -> Column:
    s = F.regexp_replace(text, r"(?i)\b(Bearer|Basic|Token)\s+[^\s,;]+", "$1 [REDACTED]")
    s = F.regexp_replace(s, r"(?s)-----BEGIN [^-]+-----.*?-----END [^-]+-----", "[REDACTED SERVICE ACCOUNT KEY]")
    return F.regexp_replace(s, r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{80,}={0,2}(?![A-Za-z0-9+/=_-])", "[REDACTED BASE64]")


_AUTH, _PEM = re.compile(r"\b(Bearer|Basic|Token)\s+[^\s,;]+", re.I), re.compile(r"-----BEGIN [^-]+-----.*?-----END [^-]+-----", re.S)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{80,}={0,2}(?![A-Za-z0-9+/=_-])")


def redact_value(value: object, key: str = "", keys: re.Pattern = re.compile(D.SENSITIVE_KEYS, re.I), instead: str = "[REDACTED]") -> object:
    """A JSON value with what sensitive keys hold, at any depth, and secrets in texts replaced."""
    if keys.search(key):
        return instead
    if isinstance(value, dict):
        return {k: redact_value(v, k, keys, instead) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_value(v, "", keys, instead) for v in value]
    if isinstance(value, str):
        return _BASE64.sub("[REDACTED BASE64]", _PEM.sub("[REDACTED SERVICE ACCOUNT KEY]", _AUTH.sub(lambda m: f"{m.group(1)} [REDACTED]", value)))
    return value


def redact_json(text: Column, keys: str = D.SENSITIVE_KEYS, instead: str = "[REDACTED]") -> Column:
    """JSON texts of any depth, which no built-in function walks; what is no JSON is treated as a text. Arrow batches."""
    pattern = re.compile(keys, re.I)

    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return json.dumps(redact_value(json.loads(text), "", pattern, instead), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return redact_value(text)

        return texts.map(one)

    return F.pandas_udf(run, "string")(text)


@query("scl44_redact", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Bearer [REDACTED]; ' WHEN 1 THEN '[REDACTED BASE64] ' ELSE '[REDACTED SERVICE ACCOUNT KEY] ' END || props AS line, '{\"a\":{\"user.api-key\":\"[REDACTED]\",\"list\":[\"basic [REDACTED], x\",{\"Token\":\"[REDACTED]\",\"n\":1}]},\"props\":' || replace(props, ' ', '') || '}' AS document FROM events")
def redacted(t: Tables) -> DataFrame:
    """Secrets in a line of text; those and what sensitive keys hold in a JSON document, at any depth."""
    n = F.col("event_id") % 3
    lead = F.when(n == 0, "Bearer abc!def-123456; ").when(n == 1, F.concat(F.repeat(F.lit("Ab3+"), F.lit(25)), F.lit("== "))).otherwise("-----BEGIN X KEY-----\nabc\n-----END X KEY----- ")
    document = F.concat(F.lit('{"a":{"user.api-key":["s",'), F.col("event_id").cast("string"), F.lit('],"list":["basic YWJj, x",{"Token":{"deep":"s"},"n":1}]},"props":'), "props", F.lit("}"))
    return t.events.select("event_id", redact(F.concat(lead, "props")).alias("line"), redact_json(document).alias("document"))


#: Marks that mean yes.
YES = ("○", "Y", "예", "TRUE", "True", "true", "1")


@query("scl45_marks", "SELECT ord, CASE WHEN mark = '' THEN NULL ELSE mark IN ('○', 'Y', '예', 'TRUE', 'True', 'true', '1') END AS marked, CASE mark WHEN 'Y' THEN true WHEN 'N' THEN false END AS yes_no FROM master")
def marks(t: Tables) -> DataFrame:
    m = F.col("mark")
    return t.master.select("ord", F.when(m != "", m.isin(*YES)).alias("marked"), F.when(m == "Y", True).when(m == "N", False).alias("yes_no"))


def column_letters(index: Column) -> Column:
    """1 -> A, 27 -> AA: base 26 without a zero, as many letters as a long needs (14). Division is in whole numbers, as doubles lose the last ones."""
    index = index.cast("long")
    least = [sum(26**i for i in range(k + 1)) for k in range(14)]  # the first index of k + 1 letters
    letter = lambda k: F.char((F.pmod(F.call_function("div", index - least[k], F.lit(26**k)), F.lit(26)) + 65).cast("int"))
    return F.concat(*(F.when(index >= least[k], letter(k)).otherwise("") for k in range(13, 0, -1)), letter(0))


def column_index(letters: Column) -> Column:
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + (F.ascii(c) - 64))


@query("scl46_column_letters", "SELECT ord, ord + 1 AS back FROM master")
def letters(t: Tables) -> DataFrame:
    """To letters and back."""
    return t.master.select("ord", column_index(column_letters(F.col("ord") + 1)).alias("back"))


_LIGHT = "CASE doc_id % 7 WHEN 0 THEN '🟢 ok ' WHEN 1 THEN ' check 🟡 two' WHEN 2 THEN '🔴' WHEN 3 THEN '🔵  next' WHEN 4 THEN '⚪' WHEN 5 THEN '🟣 none' ELSE '' END"


@query("scl47_light_colour", f"""
WITH {D.values_sql("l", "mark, colour, n", tuple((m, c, n) for n, (m, c) in enumerate(D.LIGHTS)))}, x AS (SELECT doc_id, trim({_LIGHT}) AS text FROM document), h AS (SELECT x.doc_id, min_by(l.mark, l.n) AS mark, min_by(l.colour, l.n) AS colour FROM x JOIN l ON contains(x.text, l.mark) GROUP BY x.doc_id)
SELECT x.doc_id, CASE WHEN h.mark IS NULL THEN x.text ELSE rtrim('● ' || ltrim(substr(x.text, instr(x.text, h.mark) + 1))) END AS shown, h.colour FROM x LEFT JOIN h USING (doc_id)""")
def light_colour(t: Tables) -> DataFrame:
    """The first known light of a text becomes a circle before what follows it, with the light's colour; other texts stay."""
    text = F.trim(F.expr(_LIGHT))
    after = lambda m: F.rtrim(F.concat(F.lit("● "), F.ltrim(F.substr(text, F.instr(text, m) + 1))))
    shown = F.coalesce(*(F.when(F.contains(text, F.lit(m)), after(m)) for m, _ in D.LIGHTS), text)
    colour = F.coalesce(*(F.when(F.contains(text, F.lit(m)), F.lit(c)) for m, c in D.LIGHTS), F.lit(None).cast("int"))
    return t.document.select("doc_id", shown.alias("shown"), colour.alias("colour"))


@query("scl48_file_number", "SELECT doc_id, coalesce(lpad(nullif(regexp_extract(file_name, '^([0-9]{1,3})_', 1), ''), 3, '0'), '999') AS number FROM document")
def file_number(t: Tables) -> DataFrame:
    found = F.nullif(F.regexp_extract("file_name", "^([0-9]{1,3})_", 1), F.lit(""))
    return t.document.select("doc_id", F.coalesce(F.lpad(found, 3, "0"), F.lit("999")).alias("number"))


@query("scl49_parentheses", "SELECT ord, name AS repaired FROM master")
def parentheses(t: Tables) -> DataFrame:
    """What was opened and not closed is closed, if it was last."""
    broken = F.regexp_replace("name", r"\) [0-9]+$", "")
    opens, closes = (F.length(broken) - F.length(F.replace(broken, F.lit(c), F.lit(""))) for c in "()")
    tail = F.regexp_extract("name", r"\)( [0-9]+)$", 1)
    return t.master.select("ord", F.concat(broken, F.repeat(F.lit(")"), F.greatest(opens - closes, F.lit(0))), tail).alias("repaired"))


@query("scl50_timeouts", f"""
WITH {D.values_sql("d", "doc_type, seconds", tuple((k, int(v)) for k, v in D.TIMEOUTS))}, u AS (SELECT g.doc_id, env, CAST(d.seconds AS DOUBLE) AS usual, old_env FROM goods g JOIN d USING (doc_type)),
f AS (SELECT *, CASE WHEN TRY_CAST(old_env AS DOUBLE) > 0 THEN TRY_CAST(old_env AS DOUBLE) ELSE usual END AS fallback FROM u) SELECT doc_id, CASE WHEN TRY_CAST(env AS DOUBLE) > 0 THEN TRY_CAST(env AS DOUBLE) ELSE fallback END AS seconds FROM f""")
def timeouts(t: Tables) -> DataFrame:
    """The type's own setting, else the older common one, else the type's default; a setting that is no positive number does not count."""
    usual = F.coalesce(*(F.when(F.col("doc_type") == k, F.lit(v)) for k, v in D.TIMEOUTS), F.lit(dict(D.TIMEOUTS)["text"]))
    positive = lambda c: F.when(F.col(c).try_cast("double") > 0, F.col(c).try_cast("double"))
    return t.goods.select("doc_id", F.coalesce(positive("env"), positive("old_env"), usual).alias("seconds"))


@query("scl51_text_helpers", r"SELECT ord, trim(regexp_replace(name, '\s+', ' ', 'g')) AS normal, length(regexp_replace(name, '[0-9a-zA-Z가-힣 ()]', '', 'g')) * 2 > length(name) AS garbage FROM master")
def text_helpers(t: Tables) -> DataFrame:
    odd = F.length(F.regexp_replace("name", "[0-9a-zA-Z가-힣 ()]", ""))
    return t.master.select("ord", strip_runs(F.col("name")).alias("normal"), (odd * 2 > F.length("name")).alias("garbage"))
