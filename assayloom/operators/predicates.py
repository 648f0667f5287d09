"""Filters and predicates over components, master rows, documents and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Tables, query
from ..sources import domain as D
from ..functions import cas as C
from ..functions import content as N

_CHECK = """(regexp_matches(cas, '^[0-9]{2,7}-[0-9]{2}-[0-9]$') AND list_sum(list_transform(range(1, length(replace(cas, '-', ''))),
 lambda i: i * CAST(substr(reverse(replace(cas, '-', '')), CAST(i + 1 AS INT), 1) AS INT))) % 10 = CAST(right(cas, 1) AS INT))"""


@query("flt01_cas_shape", "SELECT doc_id, seq, cas, regexp_matches(cas, '^[0-9]{2,7}-[0-9]{2}-[0-9]$') AS well_formed FROM component")
def cas_shape(t: Tables) -> DataFrame:
    return t.component.select("doc_id", "seq", "cas", C.well_formed(F.col("cas")).alias("well_formed"))


@query("flt02_cas_checksum", f"SELECT doc_id, seq, cas, {_CHECK} AS valid FROM component")
def cas_checksum(t: Tables) -> DataFrame:
    return t.component.select("doc_id", "seq", "cas", C.checksum_holds(F.col("cas")).alias("valid"))


@query("flt03_cas_genuine", f"""
WITH m AS (SELECT DISTINCT replace(cas, '-', '') AS digits FROM master WHERE ord % 3 = 0),
g AS (SELECT c.doc_id, c.seq, c.cas, m.digits IS NOT NULL AS known, CASE WHEN c.seq % 5 = 0 THEN 'contains ' || c.cas ELSE 'nothing' END AS grounding
      FROM component c LEFT JOIN m ON m.digits = replace(c.cas, '-', ''))
SELECT doc_id, seq, cas, CASE WHEN regexp_matches(cas, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN false WHEN known THEN true
 WHEN contains(grounding, cas) THEN true ELSE {_CHECK} END AS genuine FROM g""")
def cas_genuine(t: Tables) -> DataFrame:
    known = t.master.where("ord % 3 = 0").select(C.digits(F.col("cas")).alias("digits")).distinct().withColumn("known", F.lit(True))
    rows = t.component.withColumn("digits", C.digits(F.col("cas"))).join(known, "digits", "left")
    grounding = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("contains "), F.col("cas"))).otherwise("nothing")
    return rows.select("doc_id", "seq", "cas", C.genuine(F.col("cas"), F.coalesce("known", F.lit(False)), grounding).alias("genuine"))


def any_filled(*columns: str) -> Column:
    return F.exists(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), lambda x: F.trim(x) != "")


@query("flt04_not_blank", "SELECT ord, name, mark FROM master WHERE trim(coalesce(mark, '')) <> '' OR trim(coalesce(CASE WHEN ord % 4 = 0 THEN ' ' ELSE name END, '')) <> ''")
def not_blank(t: Tables) -> DataFrame:
    shown = F.when(F.col("ord") % 4 == 0, " ").otherwise(F.col("name"))
    return t.master.withColumn("shown", shown).where(any_filled("mark", "shown")).select("ord", "name", "mark")


@query("flt05_keyword_search", "SELECT ord, name, cas FROM master WHERE contains(lower(name), 'ring') OR contains(lower(cas), '-07-')")
def keyword_search(t: Tables) -> DataFrame:
    return t.master.where(F.contains(F.lower("name"), F.lit("ring")) | F.contains(F.lower("cas"), F.lit("-07-"))).select("ord", "name", "cas")


@query("flt06_eligible_first", "SELECT file_hash, doc_id, product FROM document WHERE eligible QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) = 1")
def eligible_first(t: Tables) -> DataFrame:
    first = t.document.where("eligible").groupBy("file_hash").agg(F.min(F.struct("doc_id", "product")).alias("x"))
    return first.select("file_hash", "x.doc_id", "x.product")


@query("flt07_cache_action", """
WITH cache AS (SELECT 'h' || CAST(o_custkey AS STRING) AS file_hash, CAST(max(o_orderkey % 3) AS INTEGER) AS version, bool_or(o_orderkey % 50 = 0) AS manual FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL)
SELECT d.doc_id, d.file_hash, CASE WHEN c.file_hash IS NULL THEN 'miss' WHEN c.version <> 2 OR (c.manual AND d.product_seen = '') THEN 'overwrite' ELSE 'skip' END AS action
FROM document d LEFT JOIN cache c USING (file_hash)""")
def cache_action(t: Tables) -> DataFrame:
    cache = t.orders.where("o_custkey % 2 = 0").groupBy(F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("file_hash")).agg(
        F.max(F.expr("o_orderkey % 3")).alias("version"), F.bool_or(F.expr("o_orderkey % 50 = 0")).alias("manual"))
    action = F.when(F.col("version").isNull(), "miss").when((F.col("version") != 2) | (F.col("manual") & (F.col("product_seen") == "")), "overwrite").otherwise("skip")
    return t.document.join(cache, "file_hash", "left").select("doc_id", "file_hash", action.alias("action"))


@query("flt08_section_range", "SELECT doc_id, page, id, y0 FROM word WHERE y0 + height / 2.0 >= 40 AND y0 + height / 2.0 < 160")
def section_range(t: Tables) -> DataFrame:
    middle = F.col("y0") + F.col("height") / 2
    return t.word.where((middle >= 40) & (middle < 160)).select("doc_id", "page", "id", "y0")


def table_row_kept(cells: Column) -> Column:
    """False for header rows (a cell that is a header's, signs aside) and for rows of exposure tables."""
    clean = F.transform(cells, lambda c: F.regexp_replace(F.lower(c), r"[\s().%|_]", ""))
    return ~F.arrays_overlap(clean, F.array(*map(F.lit, D.HEADER_CELLS))) & ~F.lower(F.array_join(cells, "")).rlike("|".join(D.NOISE_CELLS))


_ODD_CELL = "CASE ord % 6 WHEN 0 THEN ' CAS (No.) ' WHEN 1 THEN 'TWA 5 ppm' WHEN 2 THEN '함 유 량(%)' WHEN 3 THEN 'Chemical_Name|' ELSE twa END"


@query("flt09_header_rows", f"""
WITH r AS (SELECT ord, [name, cas, {_ODD_CELL}] AS cells FROM master)
SELECT ord, NOT list_has_any(list_transform(cells, lambda c: regexp_replace(lower(c), '[\\s().%|_]', '', 'g')), [{", ".join(f"'{w}'" for w in D.HEADER_CELLS)}])
 AND NOT ({" OR ".join(f"contains(lower(array_to_string(cells, '')), '{w}')" for w in D.NOISE_CELLS)}) AS kept FROM r""")
def header_rows(t: Tables) -> DataFrame:
    cells = F.array("name", "cas", F.expr(_ODD_CELL))
    return t.master.select("ord", table_row_kept(cells).alias("kept"))


@query("flt10_hazard_noise", """
WITH l AS (SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN 'H315 ' || content WHEN 1 THEN 'acute toxic ' || content ELSE content END AS line FROM component)
SELECT doc_id, seq, regexp_matches(lower(line), 'h[0-9]{3}|구분|category|급성|독성|acute|toxic|hazard') AND NOT (contains(line, '%') AND regexp_matches(line, '[-~]')) AS noise FROM l""")
def hazard_noise(t: Tables) -> DataFrame:
    line = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("H315 "), "content")).when(F.col("seq") % 4 == 1, F.concat(F.lit("acute toxic "), "content")).otherwise(F.col("content"))
    noise = F.lower(line).rlike(r"h[0-9]{3}|구분|category|급성|독성|acute|toxic|hazard") & ~(F.contains(line, F.lit("%")) & line.rlike("[-~]"))
    return t.component.select("doc_id", "seq", noise.alias("noise"))


@query("flt11_unit_noise", """
WITH l AS (SELECT doc_id, seq, CASE seq % 3 WHEN 0 THEN CAST(quantity AS STRING) || ' mg/kg' ELSE content END AS line FROM component)
SELECT doc_id, seq, regexp_matches(lower(line), '[0-9]\\s*[a-z]+') AND NOT regexp_matches(lower(line), '%|rem|balance') AS noise FROM l""")
def unit_noise(t: Tables) -> DataFrame:
    line = F.lower(F.when(F.col("seq") % 3 == 0, F.concat(F.col("quantity").cast("string"), F.lit(" mg/kg"))).otherwise(F.col("content")))
    return t.component.select("doc_id", "seq", (line.rlike(r"[0-9]\s*[a-z]+") & ~line.rlike("%|rem|balance")).alias("noise"))


#: Words that no product name holds.
FORBIDDEN = r"미추출|확인|실패|unknown|none"


_SHOWN_PRODUCT = "CASE doc_id % 12 WHEN 0 THEN '물질 안정 보건자료' WHEN 1 THEN 'N/A' WHEN 2 THEN '확인 불가' WHEN 3 THEN 'x' WHEN 4 THEN repeat('long', 30) WHEN 5 THEN concat(product, ' MS DS') WHEN 6 THEN 'error 5' ELSE product_seen END"


@query("flt12_product_acceptable", f"""
WITH p AS (SELECT doc_id, {_SHOWN_PRODUCT} AS name FROM document)
SELECT doc_id, name, length(trim(name)) >= 2 AND length(name) < 100 AND NOT ({" OR ".join(f"contains(name, '{w}')" for w in D.NO_PRODUCT)}) AND NOT ({" OR ".join(f"contains(replace(name, ' ', ''), '{w}')" for w in D.NO_PRODUCT_BARE)}) AS acceptable FROM p""")
def product_acceptable(t: Tables) -> DataFrame:
    """Of a sensible length, without words of failure, and not the title of the sheet itself."""
    name = F.expr(_SHOWN_PRODUCT)
    holds = lambda text, words: text.rlike("|".join(words))
    ok = (F.length(F.trim(name)) >= 2) & (F.length(name) < 100) & ~holds(name, D.NO_PRODUCT) & ~holds(F.replace(name, F.lit(" "), F.lit("")), D.NO_PRODUCT_BARE)
    return t.document.select("doc_id", name.alias("name"), ok.alias("acceptable"))


@query("flt13_cas_letter", "WITH c AS (SELECT doc_id, seq, CASE WHEN seq % 9 = 0 THEN replace(cas, '0', 'O') ELSE cas END AS cas FROM component) SELECT doc_id, seq, cas, regexp_extract(cas, '[a-zA-Z]', 0) AS letter FROM c")
def cas_letter(t: Tables) -> DataFrame:
    rows = t.component.withColumn("cas", F.when(F.col("seq") % 9 == 0, F.replace("cas", F.lit("0"), F.lit("O"))).otherwise(F.col("cas")))
    return rows.select("doc_id", "seq", "cas", F.regexp_extract("cas", "[a-zA-Z]", 0).alias("letter"))


@query("flt14_cell_noise", """
WITH r AS (SELECT doc_id, seq, page, CASE WHEN seq % 2 = 0 THEN name ELSE content END AS cell FROM component),
x AS (SELECT *, length(regexp_replace(cell, '[^a-zA-Z가-힣]', '', 'g')) AS letters, length(regexp_replace(cell, '\\s', '', 'g')) AS all_ FROM r)
SELECT doc_id, seq, NOT (all_ > 0 AND letters * 10 > all_ * 3) AND NOT (page IN (1) AND seq % 3 <> 0) AS content_cell FROM x""")
def cell_noise(t: Tables) -> DataFrame:
    cell = F.when(F.col("seq") % 2 == 0, F.col("name")).otherwise(F.col("content"))
    letters, every = F.length(F.regexp_replace(cell, "[^a-zA-Z가-힣]", "")), F.length(F.regexp_replace(cell, r"\s", ""))
    noisy = (every > 0) & (letters * 10 > every * 3)
    return t.component.select("doc_id", "seq", (~noisy & ~(F.col("page").isin(1) & (F.col("seq") % 3 != 0))).alias("content_cell"))


@query("flt15_complex_bounds", """
WITH m AS (SELECT doc_id, seq, regexp_replace(content, '[0-9]{2,7}-[0-9]{2}-[0-9]', '', 'g') AS s FROM component)
SELECT doc_id, seq, len(regexp_extract_all(s, '[<>≤≥]', 0)) >= 2 OR (len(regexp_extract_all(s, '[<>≤≥]', 0)) >= 1 AND regexp_matches(s, '[-~∼～to]')) AS complex FROM m""")
def complex_bounds(t: Tables) -> DataFrame:
    """The class of range marks holds the letters t and o, as it does where the rule comes from."""
    masked = F.regexp_replace("content", "[0-9]{2,7}-[0-9]{2}-[0-9]", "")
    signs = F.size(F.regexp_extract_all(masked, F.lit("[<>≤≥]"), 0))
    return t.component.select("doc_id", "seq", ((signs >= 2) | ((signs >= 1) & masked.rlike("[-~∼～to]"))).alias("complex"))


@query("flt16_card_layout", r"""
WITH l0 AS (SELECT *, coalesce(abs(y0 - lag(y0) OVER w) > 0.25 * least(height, lag(height) OVER w), true) AS new FROM word WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, id)),
l AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, id) AS line FROM l0), g AS (SELECT *, x0 - lag(x0 + width) OVER (PARTITION BY doc_id, page, line ORDER BY x0, id) AS gap, lag(height) OVER (PARTITION BY doc_id, page, line ORDER BY x0, id) AS tall FROM l),
k AS (SELECT doc_id, page, line, bool_or(contains(text, '성분')) AS substance, bool_or(contains(lower(text), 'cas')) AS label, bool_or(regexp_matches(text, '함유량|함량|농도')) AS field, bool_or(regexp_matches(text, '(^|[^0-9-])[0-9]{2,7}-[0-9]{2}-[0-9]([^0-9-]|$)')) AS number,
    bool_or(regexp_matches(text, '^[<>]?[0-9]+([.][0-9]+)?(~[0-9]+)?%?$')) AS amount, count(*) AS n, count(*) FILTER (WHERE gap > 2 * tall) AS gaps FROM g GROUP BY ALL)
SELECT doc_id, page, bool_or(substance) AND bool_or(label) AND bool_or(field) AND NOT (bool_or(label AND field) OR bool_or(number AND amount) OR count(*) FILTER (WHERE n >= 3 AND gaps >= 2) >= 2) AS vertical_card FROM k GROUP BY doc_id, page""")
def card_layout(t: Tables) -> DataFrame:
    """Substance, number and content each have a line of their own, and the page is no grid: no line with two of them, with a number and its amount, nor two of three columns."""
    from .windows import visual_lines

    lined = visual_lines(t.word)
    before = Window.partitionBy("doc_id", "page", "line").orderBy("x0", "id")
    wide = F.col("x0") - F.lag(F.col("x0") + F.col("width")).over(before) > 2 * F.lag("height").over(before)
    text = F.col("text")
    k = lined.withColumn("wide", wide).groupBy("doc_id", "page", "line").agg(
        F.bool_or(F.contains(text, F.lit("성분"))).alias("substance"), F.bool_or(F.contains(F.lower(text), F.lit("cas"))).alias("label"), F.bool_or(text.rlike(D.CONTENT_FIELDS)).alias("field"),
        F.bool_or(text.rlike(C.TOKEN)).alias("number"), F.bool_or(text.rlike("^[<>]?[0-9]+([.][0-9]+)?(~[0-9]+)?%?$")).alias("amount"), F.count("*").alias("n"), F.count_if("wide").alias("gaps"),
    )
    grid = F.bool_or(F.col("label") & F.col("field")) | F.bool_or(F.col("number") & F.col("amount")) | (F.count_if((F.col("n") >= 3) & (F.col("gaps") >= 2)) >= 2)
    return k.groupBy("doc_id", "page").agg((F.bool_or("substance") & F.bool_or("label") & F.bool_or("field") & ~grid).alias("vertical_card"))


@query("flt17_reuse_reason", f"""
SELECT doc_id, seq, CASE WHEN engine <> 'table' THEN 'engine not loaded' WHEN page = 1 THEN 'no clear table' WHEN NOT {_CHECK} THEN 'no valid number'
 WHEN content <> '' THEN 'row matched' ELSE 'reuse' END AS reason FROM component""")
def reuse_reason(t: Tables) -> DataFrame:
    reason = (
        F.when(F.col("engine") != "table", "engine not loaded").when(F.col("page") == 1, "no clear table")
        .when(~C.checksum_holds(F.col("cas")), "no valid number").when(F.col("content") != "", "row matched").otherwise("reuse")
    )
    return t.component.select("doc_id", "seq", reason.alias("reason"))


@query("flt18_zero_quantity", """
WITH q AS (SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN ' 0 ' WHEN 1 THEN '0,000' WHEN 2 THEN '' ELSE content END AS amount FROM component)
SELECT doc_id, seq, coalesce(regexp_replace(amount, '[ ,]', '', 'g') <> '' AND TRY_CAST(regexp_replace(amount, '[ ,]', '', 'g') AS DOUBLE) = 0, false) AS zero FROM q""")
def zero_quantity(t: Tables) -> DataFrame:
    amount = F.when(F.col("seq") % 4 == 0, " 0 ").when(F.col("seq") % 4 == 1, "0,000").when(F.col("seq") % 4 == 2, "").otherwise(F.col("content"))
    bare = F.regexp_replace(amount, "[ ,]", "")
    return t.component.select("doc_id", "seq", F.coalesce((bare != "") & (bare.try_cast("double") == 0), F.lit(False)).alias("zero"))


SENSITIVE_KEY = r"api_?key|authorization|cookie|password|secret|token"


@query("flt19_sensitive", f"""
WITH k AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'api.key' WHEN 1 THEN 'X-Authorization' WHEN 2 THEN event_type WHEN 3 THEN 'private-key' WHEN 4 THEN 'raw_text' ELSE 'user_token_id' END AS key, CASE event_id % 5 WHEN 0 THEN 'see bearer abc' WHEN 1 THEN 'authorization: x' WHEN 2 THEN '-----BEGIN A PRIVATE KEY-----' ELSE props END AS value FROM events)
SELECT event_id, key, regexp_matches(lower(key), '{D.SENSITIVE_KEYS}') AS key_hit, regexp_matches(lower(key), '{D.EXPORT_KEYS}') AS export_hit, {" OR ".join(f"regexp_matches(value, '(?i){p}')" for p in D.SECRET_TEXTS)} AS value_hit FROM k""")
def sensitive(t: Tables) -> DataFrame:
    """Keys that are masked in a journal, keys that may not leave, and texts that hold a secret."""
    n, m = F.col("event_id") % 6, F.col("event_id") % 5
    key = F.when(n == 0, "api.key").when(n == 1, "X-Authorization").when(n == 2, F.col("event_type")).when(n == 3, "private-key").when(n == 4, "raw_text").otherwise("user_token_id")
    value = F.when(m == 0, "see bearer abc").when(m == 1, "authorization: x").when(m == 2, "-----BEGIN A PRIVATE KEY-----").otherwise(F.col("props"))
    hit = F.lit(False)
    for pattern in D.SECRET_TEXTS:
        hit = hit | value.rlike("(?i)" + pattern)
    return t.events.select("event_id", key.alias("key"), F.lower(key).rlike(D.SENSITIVE_KEYS).alias("key_hit"), F.lower(key).rlike(D.EXPORT_KEYS).alias("export_hit"), hit.alias("value_hit"))


@query("flt20_upper_bound", "SELECT doc_id, seq, quantity * 3 <= 100 AS within_100, quantity * 3 <= 110 AS within_110 FROM component")
def upper_bound(t: Tables) -> DataFrame:
    amount = F.col("quantity") * 3
    return t.component.select("doc_id", "seq", (amount <= 100).alias("within_100"), (amount <= N.LIMIT).alias("within_110"))


@query("flt21_date_noise", """
WITH l AS (SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN 'Rev 3 2021-04-05 ' || content ELSE content END AS line FROM component)
SELECT doc_id, seq, trim(regexp_replace(regexp_replace(line, '20[0-2][0-9][-./][0-9]{1,2}([-./][0-9]{1,2})?', ' ', 'g'), 'Rev\\.?\\s*[0-9]*', ' ', 'g')) AS stripped FROM l""")
def date_noise(t: Tables) -> DataFrame:
    line = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Rev 3 2021-04-05 "), "content")).otherwise(F.col("content"))
    bare = F.regexp_replace(F.regexp_replace(line, "20[0-2][0-9][-./][0-9]{1,2}([-./][0-9]{1,2})?", " "), r"Rev\.?\s*[0-9]*", " ")
    return t.component.select("doc_id", "seq", F.trim(bare).alias("stripped"))


@query("flt22_clear_table", """
SELECT DISTINCT a.doc_id, a.page, a.id FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.page = b.page AND a.id <> b.id AND abs(2 * a.y0 + a.height - 2 * b.y0 - b.height) <= 2 * a.height AND greatest(a.x0, b.x0) - least(a.x0 + a.width, b.x0 + b.width) >= 18
WHERE regexp_matches(a.text, '(^|[^0-9-])[0-9]{2,7}-[0-9]{2}-[0-9]([^0-9-]|$)')""")
def clear_table(t: Tables) -> DataFrame:
    """Lines with a number that have another line beside them. Bands as high as twice a page's tallest line, so that what can meet is in the same or the next one."""
    w = t.word.select("doc_id", "page", "id", "x0", "y0", "width", "height", "text").withColumn("middle", 2 * F.col("y0") + F.col("height"))
    w = w.withColumn("tall", 2 * F.max("height").over(Window.partitionBy("doc_id", "page")))
    own = F.floor(F.col("middle") / F.col("tall"))
    left = w.where(F.col("text").rlike(C.TOKEN)).withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
    right = w.select("doc_id", "page", own.alias("band"), *(F.col(c).alias(f"{c}_b") for c in ("id", "x0", "width", "middle")))
    gap = F.greatest("x0", "x0_b") - F.least(F.col("x0") + F.col("width"), F.col("x0_b") + F.col("width_b"))
    beside = (F.abs(F.col("middle") - F.col("middle_b")) <= 2 * F.col("height")) & (gap >= 18) & (F.col("id") != F.col("id_b"))
    return left.join(right, ["doc_id", "page", "band"]).where(beside).select("doc_id", "page", "id").distinct()
