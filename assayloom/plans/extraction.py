"""From words, table cells, OCR lines and HTML to components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..catalog import Tables, query
from ..functions import cas as C
from ..functions import content as N
from ..operators.aggregates import gate_lock
from ..operators.predicates import _CHECK, table_row_kept
from ..operators.windows import _CELLS, cells
from ..sources import domain as D
from . import recovery as RC
from .recovery import recover_rows

#: A document's pages as text, in both dialects: one page for each order and page of its components.
_PAGES = "page_text AS (SELECT doc_id, page, CASE page WHEN 1 THEN '1. product ' WHEN 2 THEN '3. 구성성분 ' ELSE '4. first aid ' END || string_agg(cas || ' ' || content, chr(10) ORDER BY seq) AS text FROM component GROUP BY doc_id, page)"


def page_text(t: Tables) -> DataFrame:
    head = F.when(F.col("page") == 1, "1. product ").when(F.col("page") == 2, "3. 구성성분 ").otherwise("4. first aid ")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cas", "content"))), lambda x: F.concat(x["cas"], F.lit(" "), x["content"])), "\n")
    return t.component.groupBy("doc_id", "page").agg(lines.alias("lines")).select("doc_id", "page", F.concat(head, "lines").alias("text"))


@query("seg01_section_pages", f"""
WITH {_PAGES}, s AS (SELECT doc_id, min(page) AS start FROM page_text WHERE contains(text, '3. 구성성분') GROUP BY doc_id),
e AS (SELECT p.doc_id, min(p.page) AS stop FROM page_text p JOIN s USING (doc_id) WHERE p.page > s.start AND contains(p.text, '4. first aid') AND NOT regexp_matches(p.text, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') GROUP BY p.doc_id)
SELECT p.doc_id, p.page FROM page_text p JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) WHERE p.page BETWEEN s.start AND s.start + 2 AND (e.stop IS NULL OR p.page < e.stop)""")
def section_pages(t: Tables) -> DataFrame:
    """From the first page with the section's heading three pages at most, up to one with the next heading and no number."""
    pages = page_text(t)
    leaves = F.contains("text", F.lit("4. first aid")) & ~F.col("text").rlike("[0-9]{2,7}-[0-9]{2}-[0-9]")
    by = W.partitionBy("doc_id")
    start = F.min(F.when(F.contains("text", F.lit("3. 구성성분")), F.col("page"))).over(by)
    rows = pages.withColumn("start", start)
    rows = rows.withColumn("stop", F.min(F.when(leaves & (F.col("page") > F.col("start")), F.col("page"))).over(by))
    return rows.where("page BETWEEN start AND start + 2 AND (stop IS NULL OR page < stop)").select("doc_id", "page")


@query("seg02_section_slice", f"WITH {_PAGES} SELECT doc_id, page, CASE WHEN instr(text, '구성성분') > 0 THEN substr(text, instr(text, '구성성분') + 4) WHEN instr(text, 'product') > 0 THEN substr(text, instr(text, 'product') + 7) ELSE substr(text, 1, 12) END AS slice FROM page_text")
def section_slice(t: Tables) -> DataFrame:
    """The first of the patterns that matches anywhere wins, not the earliest place; else the head of the page."""
    cut = lambda w: F.expr(f"substr(text, instr(text, '{w}') + {len(w)})")
    found = F.when(F.instr("text", "구성성분") > 0, cut("구성성분")).when(F.instr("text", "product") > 0, cut("product")).otherwise(F.substring("text", 1, 12))
    return page_text(t).select("doc_id", "page", found.alias("slice"))


#: Height of the carrier's pages.
PAGE_HEIGHT = 300


@query("seg03_ocr_bounds", f"""
WITH m AS (SELECT doc_id, page, y0, x0, id, (2 * y0 + height) / 2.0 AS mid, regexp_matches(text, '{D.HEADING_3}') AS opens, regexp_matches(text, '{D.HEADING_4}|{D.HEADING_5}|{D.HEADING_6}') AS ends FROM word),
s AS (SELECT * FROM m WHERE opens QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, id) = 1),
e AS (SELECT m.doc_id, m.page, m.mid FROM m JOIN s ON s.doc_id = m.doc_id AND s.page = m.page WHERE m.ends AND (m.y0, m.x0, m.id) > (s.y0, s.x0, s.id) QUALIFY row_number() OVER (PARTITION BY m.doc_id, m.page ORDER BY m.y0, m.x0, m.id) = 1)
SELECT p.doc_id, p.page, coalesce(s.mid, 75) AS y_start, CASE WHEN s.mid IS NULL THEN 180 WHEN e.mid IS NULL OR e.mid <= s.mid THEN least(300, s.mid + 400) ELSE e.mid END AS y_end, s.mid IS NOT NULL AS found
FROM (SELECT DISTINCT doc_id, page FROM word) p LEFT JOIN s ON s.doc_id = p.doc_id AND s.page = p.page LEFT JOIN e ON e.doc_id = p.doc_id AND e.page = p.page""")
def ocr_bounds(t: Tables) -> DataFrame:
    """From the first heading of the section to the first of a later one behind it; parts of the page's height where they lack."""
    order = F.struct("y0", "x0", "id", ((2 * F.col("y0") + F.col("height")) / 2.0).alias("mid"))
    rows = t.word.select("doc_id", "page", order.alias("o"), F.col("text").rlike(D.HEADING_3).alias("opens"), F.col("text").rlike(f"{D.HEADING_4}|{D.HEADING_5}|{D.HEADING_6}").alias("ends"))
    start = F.min(F.when(F.col("opens"), F.col("o")))
    rows = rows.withColumn("s", start.over(W.partitionBy("doc_id", "page"))).groupBy("doc_id", "page").agg(F.first("s").alias("s"), F.min(F.when(F.col("ends") & (F.col("o") > F.col("s")), F.col("o"))).alias("e"))
    s, e = F.col("s.mid"), F.col("e.mid")
    end = F.when(s.isNull(), PAGE_HEIGHT * 0.6).when(e.isNull() | (e <= s), F.least(F.lit(float(PAGE_HEIGHT)), s + 400)).otherwise(e)
    return rows.select("doc_id", "page", F.coalesce(s, F.lit(PAGE_HEIGHT * 0.25)).alias("y_start"), end.alias("y_end"), s.isNotNull().alias("found"))


@query("seg04_exit_veto", f"SELECT doc_id, page, id, bool_or(regexp_matches(text, '(^|[^0-9-])[0-9]{{2,7}}-[0-9]{{2}}-[0-9]([^0-9-]|$)')) OVER (PARTITION BY doc_id, page ORDER BY y0, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NOT TRUE AS leaves FROM word QUALIFY regexp_matches(text, '(?i){D.EXIT_HEADING}')")
def exit_veto(t: Tables) -> DataFrame:
    """A heading of the next section ends this one only if no number stands on it or below it.

    Only headings and numbers are ordered, from below, so that each row adds itself to what is known instead of reading all rows below it again.
    """
    above = W.partitionBy("doc_id", "page").orderBy(F.desc_nulls_first("y0"), F.desc_nulls_first("id"))
    rows = t.word.select("doc_id", "page", "y0", "id", F.col("text").rlike("(?i)" + D.EXIT_HEADING).alias("heading"), F.col("text").rlike(C.TOKEN).alias("number"))
    below = F.bool_or("number").over(above.rangeBetween(W.unboundedPreceding, W.currentRow))
    return rows.where("heading OR number").withColumn("more", below).where("heading").select("doc_id", "page", "id", (~F.col("more")).alias("leaves"))


@query("seg05_block_text", "SELECT doc_id, page, string_agg(text, ' ' ORDER BY y0, x0, id) AS text FROM word GROUP BY doc_id, page")
def block_text(t: Tables) -> DataFrame:
    return t.word.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "id", "text"))), lambda x: x["text"]), " ").alias("text"))


@query("seg06_scan_class", "SELECT doc_id, CASE WHEN chars > 10 AND contains(lower(product), 'product') AND doc_id % 2 = 0 THEN 'digital' WHEN chars < 50 THEN 'scanned' ELSE 'digital' END AS class FROM document")
def scan_class(t: Tables) -> DataFrame:
    spoken = (F.col("chars") > 10) & F.contains(F.lower("product"), F.lit("product")) & (F.col("doc_id") % 2 == 0)
    return t.document.select("doc_id", F.when(spoken, "digital").when(F.col("chars") < 50, "scanned").otherwise("digital").alias("class"))


@query("seg07_document_type", "SELECT doc_id, CASE WHEN chars >= 500 AND large_images = 0 THEN 'text' WHEN chars < 30 AND (images > 0 OR chars = 0) THEN 'image' ELSE 'mixed' END AS kind FROM document")
def document_type(t: Tables) -> DataFrame:
    kind = F.when((F.col("chars") >= 500) & (F.col("large_images") == 0), "text").when((F.col("chars") < 30) & ((F.col("images") > 0) | (F.col("chars") == 0)), "image").otherwise("mixed")
    return t.document.select("doc_id", kind.alias("kind"))


@query("seg08_benchmark_class", "SELECT file_hash, CASE WHEN 2 * count(*) FILTER (WHERE large_images > 0) > count(*) THEN CASE WHEN avg(chars) < 120 THEN 'image' ELSE 'ocr layer' END ELSE 'digital' END AS class FROM document GROUP BY file_hash")
def benchmark_class(t: Tables) -> DataFrame:
    large = 2 * F.count_if(F.col("large_images") > 0) > F.count("*")
    return t.document.groupBy("file_hash").agg(F.when(large, F.when(F.avg("chars") < 120, "image").otherwise("ocr layer")).otherwise("digital").alias("class"))


@query("ext01_density_table", f"WITH {_CELLS}, x AS (SELECT doc_id, page, line, cell, string_agg(text, ' ' ORDER BY x0, id) AS text, min(x0) AS at FROM c GROUP BY ALL) SELECT doc_id, page, line, string_agg(text, ' | ' ORDER BY cell) AS row, count(*) AS cells FROM x GROUP BY doc_id, page, line")
def density_table(t: Tables) -> DataFrame:
    """Words to lines to cells to rows."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", "text"))), lambda x: x["text"]), " ")
    per = cells(t.word).groupBy("doc_id", "page", "line", "cell").agg(text.alias("text"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]), " | ")
    return per.groupBy("doc_id", "page", "line").agg(row.alias("row"), F.count("*").alias("cells"))


@query("ext02_density_boxes", f"WITH {_CELLS} SELECT doc_id, page, line, cell, min(x0) AS x0, min(y0) AS y0, max(x0 + width) AS x1, max(y0 + height) AS y1 FROM c GROUP BY ALL")
def density_boxes(t: Tables) -> DataFrame:
    return cells(t.word).groupBy("doc_id", "page", "line", "cell").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(F.col("x0") + F.col("width")).alias("x1"), F.max(F.col("y0") + F.col("height")).alias("y1"))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text holds one of words: one expression, which is compiled."""
    return text.rlike("|".join(map(re.escape, words)))


def match_score(row: Column, amount: Column, at: Column, percent_header: Column, fall: Column) -> Column:
    """The score of an amount that begins at position at (from 1) of a row with one anchor, as recovery.score gives it. fall: null where heights do not count."""
    cut = lambda n: F.lower(F.substr(row, F.greatest(at - n, F.lit(1)), F.length(amount) + n + F.least(at - 1, F.lit(n))))
    near, wide, percent = cut(RC.NEAR), cut(RC.WIDE), F.contains(amount, F.lit("%"))
    heading = F.length(F.regexp_extract(row, "(?i)" + RC.ROW_HEADING.pattern, 0))
    marked = any_of(amount, RC.SIGNS)
    inner = F.regexp_replace(amount, r"^[ \-∼~<>–—≤≥=]+|[ \-∼~<>–—≤≥=]+$", "")
    figures = F.transform(F.regexp_extract_all(amount, F.lit(r"[0-9]+\.?[0-9]*"), 0), lambda x: x.cast("double"))
    large = F.exists(figures, lambda f: f > N.LIMIT)
    first_large = F.coalesce(F.array_position(F.transform(figures, lambda f: f > N.LIMIT), True), F.lit(0))
    years = F.size(F.filter(F.when(large, F.slice(figures, F.lit(1), F.greatest(first_large - 1, F.lit(0)).cast("int"))).otherwise(figures), lambda f: f.between(1990, 2030)))
    when = lambda c, n: F.when(c, n).otherwise(0)
    points = (
        when(any_of(wide, RC.REVISIONS), RC.REVISED) + when(any_of(near, RC.REMARKS), RC.REMARKED) + F.when(percent, RC.PERCENT).when(percent_header, RC.HEADED).otherwise(0) + when(marked, RC.SIGNED)
        + when(F.contains(amount, F.lit(".")), RC.DECIMAL) + when(F.contains(cut(RC.WIDER), F.lit("concentration")), RC.CONCENTRATION) + when((F.regexp_replace(amount, "[^0-9.]", "") == "100") & ~marked, RC.WHOLE)
        - when((fall > RC.LEVEL) & ~F.contains(wide, F.lit("concentration")), 2 * fall) + when(large, RC.TOO_LARGE) + years * RC.YEAR
    )
    out = F.substr(row, at, F.length(amount) + 5).rlike(r"%\s*:") | any_of(near, RC.UNITS) | (
        ~percent & ((at <= heading) | (~percent_header & ~any_of(F.lower(amount), RC.SPOKEN_SIGNS)) | any_of(wide, RC.NO_CONTENT) | any_of(wide, RC.PAGE_WORDS))
    ) | (F.length(inner) - F.length(F.replace(inner, F.lit("-"), F.lit(""))) >= 2)
    return F.when(out, RC.OUT).when(F.abs(F.instr(row, RC.ANCHOR) - at) > RC.REACH, RC.FAR).otherwise(points)


#: A row around each content, in one of many surroundings.
_AMOUNT = "CASE WHEN content IN ('', 'Rem.', '미기재%') THEN CASE seq % 3 WHEN 0 THEN '100%' WHEN 1 THEN '2004-11-3' ELSE '200.5 %' END ELSE content END"
_LEAD = "CASE seq % 7 WHEN 0 THEN '3. 구성성분 ' WHEN 1 THEN 'Rev. 2 Solvent ' WHEN 2 THEN concat('x ', repeat('long ', 50)) WHEN 3 THEN 'concentration of solvent ' WHEN 4 THEN 'EC 번호 9 ' ELSE 'Solvent ' END"
_TAIL = "CASE quantity % 6 WHEN 0 THEN ' note' WHEN 1 THEN ' ppm' WHEN 2 THEN ' 쪽 3' WHEN 3 THEN ' : x' ELSE ' end' END"
_HAS = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query("sco01_match_score", rf"""
WITH x AS (SELECT doc_id, seq, {_AMOUNT} AS m, '[CAS_ANCHOR] ' || {_LEAD} AS lead, {_TAIL} AS tail, page = 1 AS head, CASE WHEN quantity % 4 = 0 THEN NULL ELSE quantity END AS fall FROM component),
y AS (SELECT *, CASE WHEN starts_with(lead, '[CAS_ANCHOR] 3.') THEN substr(lead, 14) || '[CAS_ANCHOR] ' ELSE lead END || m || tail AS txt, length(lead) + 1 AS pos FROM x),
z AS (SELECT *, lower(txt[greatest(pos - 10, 1):pos + length(m) + 9]) AS near, lower(txt[greatest(pos - 30, 1):pos + length(m) + 29]) AS wide, lower(txt[greatest(pos - 60, 1):pos + length(m) + 59]) AS wider, contains(m, '%') AS pc,
    length(regexp_extract(txt, '(?i)^\s*(?:SECTION\s*|항\s*)?\d+\s*[\.\s:：항\-\/]*(?:구성\s*성분|성분|COMPOSITION|INGREDIENTS?)', 0)) AS heading, {_HAS("m", RC.SIGNS)} AS marked, trim(m, ' -∼~<>–—≤≥=') AS bare,
    list_transform(regexp_extract_all(m, '[0-9]+\.?[0-9]*', 0), lambda f: CAST(f AS DOUBLE)) AS figures FROM y),
w AS (SELECT *, coalesce(list_position(list_transform(figures, lambda f: f > 110), true), 0) AS big FROM z)
SELECT doc_id, seq, CAST(CASE WHEN regexp_matches(txt[pos:pos + length(m) + 4], '%\s*:') OR {_HAS("near", RC.UNITS)} THEN -5000
    WHEN NOT pc AND (pos <= heading OR (NOT head AND NOT {_HAS("lower(m)", RC.SPOKEN_SIGNS)}) OR {_HAS("wide", RC.NO_CONTENT)} OR {_HAS("wide", RC.PAGE_WORDS)}) THEN -5000
    WHEN length(bare) - length(replace(bare, '-', '')) >= 2 THEN -5000 WHEN abs(instr(txt, '[CAS_ANCHOR]') - pos) > 220 THEN -8000
    ELSE CASE WHEN {_HAS("wide", RC.REVISIONS)} THEN -8000 ELSE 0 END + CASE WHEN {_HAS("near", RC.REMARKS)} THEN -12000 ELSE 0 END + CASE WHEN pc THEN 500 WHEN head THEN 400 ELSE 0 END + CASE WHEN marked THEN 300 ELSE 0 END
    + CASE WHEN contains(m, '.') THEN 100 ELSE 0 END + CASE WHEN contains(wider, 'concentration') THEN 15000 ELSE 0 END + CASE WHEN regexp_replace(m, '[^0-9.]', '', 'g') = '100' AND NOT marked THEN 20000 ELSE 0 END
    - CASE WHEN fall > 12 AND NOT contains(wide, 'concentration') THEN 2 * fall ELSE 0 END + CASE WHEN big > 0 THEN -5000 ELSE 0 END
    - 2000 * len(list_filter(CASE WHEN big > 0 THEN figures[1:big - 1] ELSE figures END, lambda f: f BETWEEN 1990 AND 2030)) END AS BIGINT) AS score FROM w""")
def match_scores(t: Tables) -> DataFrame:
    lead, m = F.concat(F.lit("[CAS_ANCHOR] "), F.expr(_LEAD)), F.expr(_AMOUNT)
    turned = F.when(F.startswith(lead, F.lit("[CAS_ANCHOR] 3.")), F.concat(F.substr(lead, F.lit(14)), F.lit("[CAS_ANCHOR] "))).otherwise(lead)
    fall = F.when(F.col("quantity") % 4 != 0, F.col("quantity"))
    rows = t.component.select("doc_id", "seq", F.concat(turned, m, F.expr(_TAIL)).alias("row"), m.alias("m"), (F.length(lead) + 1).alias("at"), (F.col("page") == 1).alias("head"), fall.alias("fall"))
    return rows.select("doc_id", "seq", match_score(*(F.col(c) for c in ("row", "m", "at", "head", "fall"))).cast("long").alias("score"))


@query("sco02_recon_confidence", f"""
WITH x AS (SELECT doc_id, page, regexp_matches(text, '{D.HEADING_3}') AS h, contains(lower(text), 'cas') AS l, {_CHECK.replace("cas", "text").replace("CAST(", "TRY_CAST(")} AS v, regexp_matches(text, '{D.CONTENT_FIELDS}|%') AS c, regexp_matches(text, '{D.HEADING_4}') AS n FROM word),
s AS (SELECT doc_id, page, 35 * max(h::INT) + 15 * max(l::INT) + 25 * max(coalesce(v, false)::INT) + 15 * max(c::INT) + 10 * max(n::INT) AS score, bool_or(h) AS heading FROM x GROUP BY ALL)
SELECT doc_id, page, CAST(score AS INTEGER) AS score, heading AND score >= 60 AS accepted FROM s""")
def recon_confidence(t: Tables) -> DataFrame:
    """Points for a heading, a label, a genuine number, a word of contents and the next section; accepted with a heading and enough of them."""
    text = F.col("text")
    shown = {"h": text.rlike(D.HEADING_3), "l": F.contains(F.lower(text), F.lit("cas")), "v": C.checksum_holds(text), "c": text.rlike(D.CONTENT_FIELDS + "|%"), "n": text.rlike(D.HEADING_4)}
    points = {"h": 35, "l": 15, "v": 25, "c": 15, "n": 10}
    flags = t.word.select("doc_id", "page", *(F.coalesce(e, F.lit(False)).alias(c) for c, e in shown.items())).groupBy("doc_id", "page").agg(*(F.bool_or(c).alias(c) for c in shown))
    score = sum((F.col(c).cast("int") * n for c, n in points.items()), F.lit(0))
    return flags.select("doc_id", "page", score.alias("score"), (F.col("h") & (score >= 60)).alias("accepted"))


#: Pages as sheets print them: a heading, a row for each component, the next heading; rows with an amount, one that a note spoils, one in words, none.
_SHAPE = "(seq + quantity) % 5"


def printed_pages(t: Tables) -> DataFrame:
    """doc_id, page, id, x0, y0, width, height, text of the words of one page a document."""
    rows = t.component.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))).withColumn("shape", F.expr(_SHAPE))
    q = F.col("quantity").cast("string")
    tail = F.when(F.col("shape") == 0, F.array(F.concat(q, F.lit("%")))).when(F.col("shape") == 1, F.array(F.concat(q, F.lit("%")), F.lit("Note"))).when(F.col("shape") == 2, F.array(q, F.lit("미만"))).when(
        F.col("shape") == 3, F.array(q, F.lit("-"), (F.col("quantity") + 7).cast("string"))).otherwise(F.array().cast("array<string>"))
    lines = rows.select("doc_id", (40 + 100 * F.col("nth")).alias("y0"), F.concat(F.array(F.lit("Solvent"), F.col("cas")), tail).alias("texts"))
    docs = rows.groupBy("doc_id").agg(F.max("nth").alias("n"))
    head = docs.select("doc_id", F.lit(100).alias("y0"), F.array(*map(F.lit, ("3.", "구성성분의", "명칭", "및", "함유량"))).alias("texts"))
    foot = docs.select("doc_id", (140 + 100 * F.col("n")).alias("y0"), F.array(F.lit("4."), F.lit("응급조치요령")).alias("texts"))
    words = lines.unionByName(head).unionByName(foot).select("doc_id", F.col("y0").cast("long"), F.posexplode("texts").alias("i", "text"))
    return words.select("doc_id", F.lit(1).alias("page"), (F.col("y0") * 100 + F.col("i")).alias("id"), (20 + 90 * F.col("i")).cast("long").alias("x0"), "y0", F.lit(70).cast("long").alias("width"), F.lit(10).cast("long").alias("height"), "text")


@query("ext03_regex_recovery", f"""
SELECT doc_id, cas, CASE {_SHAPE} WHEN 0 THEN CAST(quantity AS STRING) || '%' WHEN 2 THEN '<' || CAST(quantity AS STRING) || '%' WHEN 3 THEN CAST(quantity AS STRING) || '~' || CAST(quantity + 7 AS STRING) || '%' ELSE '미기재%' END AS content FROM component""")
def regex_recovery(t: Tables) -> DataFrame:
    return recover_rows(printed_pages(t)).select("doc_id", "cas", "content")


@query("ext04_table_rows", """
WITH r AS (SELECT doc_id, seq, [name, cas, content] AS cells FROM component), k AS (SELECT * FROM r WHERE NOT regexp_matches(lower(array_to_string(cells, ' ')), 'twa|stel|pel|tlv|mg/m|노출기준|exposure'))
SELECT doc_id, seq, regexp_extract(array_to_string(cells, ' '), '([0-9]{2,7}-[0-9]{2}-[0-9])', 1) AS cas, coalesce(list_filter(cells, lambda c: regexp_matches(c, '[0-9]') AND contains(c, '%'))[1], list_filter(cells, lambda c: regexp_matches(c, '^[<>≤≥ ]*[0-9.]+( ?[-~<>미이].*)?$') AND NOT regexp_matches(c, '^[0-9]{2,7}-[0-9]{2}-[0-9]$'))[1], '') AS content FROM k""")
def table_rows(t: Tables) -> DataFrame:
    """The number of a row anywhere in it; of its cells an amount with a per cent sign first, then a bare one."""
    rows = t.component.select("doc_id", "seq", F.array("name", "cas", "content").alias("cells")).where(table_row_kept(F.col("cells")))
    strong = F.filter("cells", lambda c: c.rlike("[0-9]") & F.contains(c, F.lit("%")))
    weak = F.filter("cells", lambda c: c.rlike("^[<>≤≥ ]*[0-9.]+( ?[-~<>미이].*)?$") & ~C.well_formed(c))
    return rows.select("doc_id", "seq", F.regexp_extract(F.array_join("cells", " "), "([0-9]{2,7}-[0-9]{2}-[0-9])", 1).alias("cas"), F.coalesce(F.get(strong, F.lit(0)), F.get(weak, F.lit(0)), F.lit("")).alias("content"))


@query("ext05_table_and_text", """
WITH u AS (SELECT doc_id, cas, seq, content FROM component WHERE engine = 'table' UNION ALL SELECT doc_id, cas, seq + 10000000000, CASE WHEN content = '' THEN '미기재%' ELSE content END FROM component WHERE engine <> 'table')
SELECT doc_id, cas, content FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, cas ORDER BY CASE WHEN contains(content, '~') THEN 0 WHEN content NOT IN ('', '미기재%') THEN 1 ELSE 2 END, seq) = 1""")
def table_and_text(t: Tables) -> DataFrame:
    c = t.component.select("doc_id", "cas", "seq", "content", "engine")
    text = c.where("engine <> 'table'").withColumns({"seq": F.col("seq") + 10_000_000_000, "content": F.when(F.col("content") == "", N.MISSING).otherwise(F.col("content"))})
    return gate_lock(c.where("engine = 'table'").unionByName(text).drop("engine")).select("doc_id", "cas", "content")


def html_rows(html: Column) -> Column:
    """The cells of each table row, tags stripped; spans are not carried over rows."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), strip))


@query("ext06_html_table", "SELECT doc_id, cas, trim(content) AS content FROM component")
def html_table(t: Tables) -> DataFrame:
    """Tables are written as HTML and read back."""
    row = F.concat(F.lit("<tr>\n<td class=x>"), "name", F.lit("</td><td><b>"), "cas", F.lit("</b></td><TD>"), F.replace("content", F.lit("<"), F.lit("&lt;")), F.lit("</TD></tr>"))
    html = t.component.groupBy("doc_id").agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return html.select("doc_id", F.explode(html_rows(F.col("html"))).alias("c")).select("doc_id", F.get("c", F.lit(1)).alias("cas"), F.replace(F.get("c", F.lit(2)), F.lit("&lt;"), F.lit("<")).alias("content"))


_LINE = "CASE seq % 5 WHEN 0 THEN concat(CAST(quantity AS STRING), '% ', cas, ' x') WHEN 1 THEN concat(cas, ' ', content, ' 3 ', '64-17-5') WHEN 2 THEN concat('<', CAST(quantity AS STRING), ' ', cas) WHEN 3 THEN concat(cas, ' 1 ~ ', CAST(quantity + 1 AS STRING), ' % 99% none') ELSE concat('a ', cas, ' b') END"
_OCR_AMOUNT = r"(?:[<>≤≥≦≧]\s*)?[0-9]+(?:\.[0-9]+)?(?:\s*(?:~|∼|～|–|—|to)\s*[<>≤≥≦≧]?\s*[0-9]+(?:\.[0-9]+)?)?"
_OCR_SQL = f"""
WITH l AS (SELECT doc_id, seq, cas AS own, {_LINE} AS line FROM component), n AS (SELECT doc_id, seq, line, unnest(CASE WHEN seq % 5 = 1 THEN [own, '64-17-5'] ELSE [own] END) AS cas, unnest(CASE WHEN seq % 5 = 1 THEN [0, 1] ELSE [0] END) AS nth FROM l),
r AS (SELECT doc_id, seq, cas, nth, line, trim(substr(line, instr(line, cas) + length(cas)) || ' ' || left(line, instr(line, cas) - 1)) AS rest FROM n),
c AS (SELECT doc_id, seq, cas, nth, CASE WHEN len(regexp_extract_all(rest, '{_OCR_AMOUNT}\\s*%', 0)) > 0 THEN list_reverse(regexp_extract_all(rest, '{_OCR_AMOUNT}\\s*%', 0)) ELSE [regexp_extract_all(rest, '{_OCR_AMOUNT}', 0)[-1]] END AS found FROM r),
e AS (SELECT doc_id, seq, cas, nth, unnest(found) AS raw, unnest(range(1, len(found) + 1)) AS i FROM c)"""


@query("ext07_ocr_pairs", f"""{_OCR_SQL},
k AS (SELECT * FROM ({N.normalise_sql("SELECT * FROM e WHERE raw IS NOT NULL", "raw", "content")}) WHERE content <> '미기재%' AND {_CHECK})
SELECT doc_id, cas, content FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, cas ORDER BY seq, nth, i, content) = 1""")
def ocr_pairs(t: Tables) -> DataFrame:
    """For each number of a line the last explicit percentage of what follows it and what stands before it, else the last figure, if either is an amount; of a
    document's repeated numbers the first with an amount."""
    lines = t.component.select("doc_id", "seq", F.expr(_LINE).alias("line"))
    each = lines.select("doc_id", "seq", "line", F.posexplode(F.regexp_extract_all("line", F.lit(C.TOKEN), 1)).alias("nth", "cas")).where(C.checksum_holds(F.col("cas")))
    at = F.instr("line", F.col("cas"))
    rest = F.trim(F.concat(F.substr("line", at + F.length("cas")), F.lit(" "), F.substr("line", F.lit(1), at - 1)))
    explicit = F.regexp_extract_all(rest, F.lit(_OCR_AMOUNT + r"\s*%"), 0)
    found = F.when(F.size(explicit) > 0, F.reverse(explicit)).otherwise(F.slice(F.reverse(F.regexp_extract_all(rest, F.lit(_OCR_AMOUNT), 0)), 1, 1))
    raw = each.select("doc_id", "seq", "nth", "cas", F.posexplode(found).alias("i", "raw"))
    amounts = N.normalise(raw, "raw", "content").where(F.col("content") != N.MISSING)
    first = F.min(F.struct("seq", "nth", "i", "content")).alias("x")
    return amounts.groupBy("doc_id", "cas").agg(first).select("doc_id", "cas", "x.content")


@query("ext08_quality_control", f"""
WITH x AS (SELECT doc_id, seq, ltrim(cas, '0') AS cas, content FROM component), v AS (SELECT * FROM x WHERE {_CHECK})
SELECT doc_id, cas, content FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, cas ORDER BY CASE WHEN contains(content, '~') THEN 0 WHEN content NOT IN ('', '미기재%') THEN 1 ELSE 2 END, seq) = 1""")
def quality_control(t: Tables) -> DataFrame:
    """Lists of numbers and contents are zipped (a short list of contents repeats its first), checked and gate-locked."""
    lists = t.component.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "cas", "content"))).alias("x"))
    pairs = lists.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.seq", C.strip_zeros(F.concat(F.lit("00"), F.col("x.cas"))).alias("cas"), F.coalesce("x.content", F.lit("")).alias("content"))
    return gate_lock(pairs.where(C.checksum_holds(F.col("cas")))).select("doc_id", "cas", "content")


@query("ext09_self_diagnosis", f"SELECT doc_id, count(*) FILTER (WHERE NOT {_CHECK}) AS invalid, count(*) FILTER (WHERE content = '') AS unaligned, CAST(sum(quantity) AS BIGINT) > 110 AS unbalanced FROM component GROUP BY doc_id")
def self_diagnosis(t: Tables) -> DataFrame:
    return t.component.groupBy("doc_id").agg(F.count_if(~C.checksum_holds(F.col("cas"))).alias("invalid"), F.count_if(F.col("content") == "").alias("unaligned"), (F.sum("quantity") > N.LIMIT).alias("unbalanced"))


@query("ext10_perfect", f"SELECT doc_id, bool_and({_CHECK} AND content NOT IN ('', '미기재%') AND quantity <= 100) AND count(*) = count(DISTINCT cas) AND sum(quantity) <= 110 AS perfect FROM component GROUP BY doc_id")
def perfect(t: Tables) -> DataFrame:
    each = C.checksum_holds(F.col("cas")) & ~F.col("content").isin("", N.MISSING) & (F.col("quantity") <= 100)
    per = t.component.groupBy("doc_id", "cas").agg(F.every(each).alias("fine"), F.count("*").alias("n"), F.sum("quantity").alias("q"))
    return per.groupBy("doc_id").agg((F.every("fine") & (F.max("n") == 1) & (F.sum("q") <= N.LIMIT)).alias("perfect"))


@query("ext11_response_fields", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k, event_id % 2 = 0 AS listed FROM events")
def response_fields(t: Tables) -> DataFrame:
    """Fenced JSON, an object or a list of one, under either of two keys."""
    inner = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.replace("props", F.lit('"k"'), F.lit('"content"')), F.lit("]"))).otherwise(F.col("props"))
    text = F.regexp_replace(F.concat(F.lit("```json\n"), inner, F.lit("\n```")), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    v = F.try_parse_json(text)
    found = F.coalesce(F.try_variant_get(v, "$.k", "int"), F.try_variant_get(v, "$[0].content", "int"), F.try_variant_get(v, "$.content", "int"))
    return t.events.select("event_id", found.alias("k"), F.startswith(text, F.lit("[")).alias("listed"))
