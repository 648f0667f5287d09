"""Ordered operators: lines and cells of a page, islands, running numbers, deduplication, sorting, top-k and set operations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..catalog import Tables, query
from ..sources import domain as D
from ..functions import cas as C
from ..functions import content as N


def island(new: Column, by: list[str], order: list[str]) -> Column:
    """A running number of the rows at which a new group begins."""
    return F.sum(new.cast("int")).over(W.partitionBy(*by).orderBy(*order))


def visual_lines(words: DataFrame) -> DataFrame:
    """words with line: a new line begins where y moves by more than a quarter of the smaller height of a word and the one before."""
    order = W.partitionBy("doc_id", "page").orderBy("y0", "x0", "id")
    moved = F.abs(F.col("y0") - F.lag("y0").over(order)) > 0.25 * F.least("height", F.lag("height").over(order))
    return words.withColumn("new", F.coalesce(moved, F.lit(True))).withColumn("line", island(F.col("new"), ["doc_id", "page"], ["y0", "x0", "id"])).drop("new")


_LINES = """
l0 AS (SELECT *, coalesce(abs(y0 - lag(y0) OVER w) > 0.25 * least(height, lag(height) OVER w), true) AS new FROM word WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, id)),
l AS (SELECT *, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, id) AS BIGINT) AS line FROM l0)"""


@query("win01_visual_lines", f"WITH {_LINES} SELECT doc_id, page, id, line FROM l")
def lines(t: Tables) -> DataFrame:
    return visual_lines(t.word).select("doc_id", "page", "id", "line")


def cells(words: DataFrame) -> DataFrame:
    """words with line and cell: a gap wider than the height of the word before, times the page's median gap over its median height, begins a cell."""
    w = W.partitionBy("doc_id", "page", "line").orderBy("x0", "id")
    gap = F.col("x0") - F.lag(F.col("x0") + F.col("width")).over(w)
    lined = visual_lines(words).withColumns({"gap": gap, "before": F.lag("height").over(w)})
    page = W.partitionBy("doc_id", "page")
    ratio = F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(page) / F.median("height").over(page), F.lit(0.5))
    new = F.coalesce(F.col("gap") > F.col("before") * F.col("ratio"), F.lit(True))
    return lined.withColumn("ratio", ratio).withColumn("new", new).withColumn("cell", island(F.col("new"), ["doc_id", "page", "line"], ["x0", "id"])).drop("new", "gap", "before", "ratio")


_CELLS = f"""{_LINES},
c00 AS (SELECT *, x0 - lag(x0 + width) OVER w AS gap, lag(height) OVER w AS before FROM l WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x0, id)),
c0 AS (SELECT *, coalesce(gap > before * coalesce(median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY doc_id, page) / median(height) OVER (PARTITION BY doc_id, page), 0.5), true) AS fresh FROM c00),
c AS (SELECT *, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id, page, line ORDER BY x0, id) AS BIGINT) AS cell FROM c0)"""


@query("win02_cells", f"WITH {_CELLS} SELECT doc_id, page, line, cell, string_agg(text, ' ' ORDER BY x0, id) AS text, min(x0) AS x0, max(x0 + width) AS x1 FROM c GROUP BY ALL")
def cell_texts(t: Tables) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", "text"))), lambda s: s["text"]), " ")
    return cells(t.word).groupBy("doc_id", "page", "line", "cell").agg(text.alias("text"), F.min("x0").alias("x0"), F.max(F.col("x0") + F.col("width")).alias("x1"))


@query("win03_grid_pages", f"""WITH {_LINES}, g AS (SELECT doc_id, page, line, x0 - lag(x0 + width) OVER (PARTITION BY doc_id, page, line ORDER BY x0, id) AS gap, height FROM l),
n AS (SELECT doc_id, page, line, count(*) FILTER (WHERE gap > 2 * height) AS gaps FROM g GROUP BY ALL) SELECT doc_id, page, count(*) FILTER (WHERE gaps >= 2) >= 2 AS grid FROM n GROUP BY doc_id, page""")
def grid_pages(t: Tables) -> DataFrame:
    gap = F.col("x0") - F.lag(F.col("x0") + F.col("width")).over(W.partitionBy("doc_id", "page", "line").orderBy("x0", "id"))
    wide = visual_lines(t.word).withColumn("wide", gap > 2 * F.col("height")).groupBy("doc_id", "page", "line").agg(F.count_if("wide").alias("gaps"))
    return wide.groupBy("doc_id", "page").agg((F.count_if(F.col("gaps") >= 2) >= 2).alias("grid"))


#: Fields that let an amount wait for the next row, and words that begin one.
_FIELDS = re.compile(r"content|percentage|함량|함유량|composition|ingredient|component|concentration|조성|구성|min|max|approx|wt", re.I)
_AMOUNT, _NEW_ROW = re.compile(r"%|\b\d{1,3}\.\d{2}\b"), re.compile(r"ingredient|component|물질명|성분명|chemical name", re.I)


def logical_rows(lines: list[tuple[float, int, str, bool]]) -> list[int]:
    """The row of each line (y, line, text, whether it holds a number) of a page, in order; -1: of none. A line with a number opens a row, near lines
    below join it unless they name a new ingredient, and what comes before the first such line, or too far below one, is held for the next; but
    a held line that states an amount without a field belongs to none."""
    rows, held, current, last = [-1] * len(lines), [], None, 0.0
    for i, (y, line, text, anchor) in enumerate(lines):
        if anchor:
            current, last = line, y
            for k in [*(h for h in held if not _AMOUNT.search(lines[h][2]) or _FIELDS.search(lines[h][2])), i]:
                rows[k] = line
            held = []
        elif current is not None and y - last < 80 and not _NEW_ROW.search(text):
            rows[i], last = current, y
        else:
            current = None
            held.append(i)
    return rows


def logical_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page, line, row of lines (doc_id, page, line, y, text, anchor): the fold of a page, in Arrow batches of pages."""
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), "line", "text", "anchor"))).alias("x"))

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: logical_rows([(r["y"], r["line"], r["text"], r["anchor"]) for r in p]))

    found = pages.select("doc_id", "page", F.transform("x", lambda r: r["line"]).alias("line"), F.pandas_udf(run, "array<long>")("x").alias("row"))
    return found.select("doc_id", "page", F.explode(F.arrays_zip("line", "row")).alias("z")).select("doc_id", "page", "z.*")


@query("win04_logical_rows")
def logical(t: Tables) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", "text"))), lambda s: s["text"]), " ")
    rows = visual_lines(t.word).groupBy("doc_id", "page", "line").agg(F.min("y0").alias("y"), text.alias("text"), F.bool_or(F.col("text").rlike(C.TOKEN)).alias("anchor"))
    return logical_lines(rows)


@query("win05_card_blocks", f"WITH {_LINES}, k AS (SELECT doc_id, page, line, bool_or(contains(text, '성분')) AS opens FROM l GROUP BY ALL) SELECT doc_id, page, line, CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY line) AS BIGINT) AS block FROM k")
def card_blocks(t: Tables) -> DataFrame:
    opens = visual_lines(t.word).groupBy("doc_id", "page", "line").agg(F.bool_or(F.contains("text", F.lit("성분"))).alias("opens"))
    return opens.select("doc_id", "page", "line", island(F.col("opens"), ["doc_id", "page"], ["line"]).alias("block"))


_LONE = "(seq + quantity) % 4 = 0"


@query("win06_back_fill", f"""
WITH r AS (SELECT doc_id, seq, cas, {_LONE} AS lone, content, CASE WHEN content IN ('', '미기재%') THEN NULL WHEN {_LONE} THEN 'L' || content ELSE 'S' END AS mark FROM component),
n AS (SELECT *, first_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq, content ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM r)
SELECT doc_id, seq, CASE WHEN content NOT IN ('', '미기재%') THEN content WHEN starts_with(next, 'L') THEN substr(next, 2) ELSE '미기재%' END AS content FROM n WHERE NOT lone""")
def back_fill(t: Tables) -> DataFrame:
    """A row of a content alone fills the missing rows right above it, up to one that states its own. (Carrier: every fourth row has no number.)"""
    lone, stated = F.expr(_LONE), ~F.col("content").isin("", N.MISSING)
    mark = F.when(stated, F.when(lone, F.concat(F.lit("L"), "content")).otherwise("S"))
    below = W.partitionBy("doc_id").orderBy("seq", "content").rowsBetween(1, W.unboundedFollowing)
    rows = t.component.withColumn("next", F.first(mark, ignorenulls=True).over(below)).where(~lone)
    filled = F.when(stated, F.col("content")).when(F.startswith("next", F.lit("L")), F.substr("next", F.lit(2))).otherwise(N.MISSING)
    return rows.select("doc_id", "seq", filled.alias("content"))


_RUNS = """
s AS (SELECT doc_id, seq, engine, coalesce(engine <> lag(engine) OVER (PARTITION BY doc_id ORDER BY seq), true) AS new FROM component),
r AS (SELECT doc_id, seq, engine, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS run FROM s)"""


def runs(components: DataFrame) -> DataFrame:
    new = F.coalesce(F.col("engine") != F.lag("engine").over(W.partitionBy("doc_id").orderBy("seq")), F.lit(True))
    return components.withColumn("new", new).withColumn("run", island(F.col("new"), ["doc_id"], ["seq"])).drop("new")


@query("win07_run_islands", f"WITH {_RUNS} SELECT doc_id, run, any_value(engine) AS engine, min(seq) AS first, max(seq) AS last, count(*) AS n FROM r GROUP BY doc_id, run")
def run_islands(t: Tables) -> DataFrame:
    return runs(t.component).groupBy("doc_id", "run").agg(F.min("engine").alias("engine"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


@query("win08_serial_numbers", f"""WITH {_RUNS}, g AS (SELECT doc_id, run, min(engine) AS engine, count(*) AS n FROM r GROUP BY doc_id, run), k AS (SELECT *, CASE WHEN engine = 'density' AND n = 1 THEN 0 ELSE n END AS takes FROM g)
SELECT doc_id, run, CAST(sum(takes) OVER (PARTITION BY doc_id ORDER BY run) - takes + 1 AS BIGINT) AS first_number, CAST(takes AS BIGINT) AS takes FROM k""")
def serial_numbers(t: Tables) -> DataFrame:
    """Each group that is not skipped takes as many numbers as it has rows."""
    g = runs(t.component).groupBy("doc_id", "run").agg(F.min("engine").alias("engine"), F.count("*").alias("n"))
    takes = F.when((F.col("engine") == "density") & (F.col("n") == 1), 0).otherwise(F.col("n"))
    upto = F.sum("takes").over(W.partitionBy("doc_id").orderBy("run"))
    return g.withColumn("takes", takes).select("doc_id", "run", (upto - F.col("takes") + 1).alias("first_number"), "takes")


_TIMES = "CASE (doc_id + quantity) % 9 WHEN 0 THEN '3' WHEN 1 THEN '횟수조정' WHEN 2 THEN ' 0 ' ELSE '' END"
_COUNT = "CASE doc_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN '-2' WHEN 2 THEN '' WHEN 3 THEN '2.7' ELSE '3' END"


@query("win09_skipped_groups", f"""
WITH g AS (SELECT doc_id, bool_and(trim({_TIMES}) IN ('횟수조정', '0', '')) AS adjusted, coalesce(TRY_CAST({_COUNT} AS DOUBLE), 0) AS n FROM component GROUP BY doc_id)
SELECT doc_id, adjusted OR trunc(n) <= 0 AS skipped, CASE WHEN adjusted OR trunc(n) <= 0 THEN 0 ELSE CAST(trunc(n) AS BIGINT) END AS numbers FROM g""")
def skipped_groups(t: Tables) -> DataFrame:
    """A group gets no numbers if all its rows are adjusted, nought or blank, or if its count is no positive number; a fraction counts down."""
    g = t.component.groupBy("doc_id").agg(F.every(F.trim(F.expr(_TIMES)).isin("횟수조정", "0", "")).alias("adjusted"))
    n = F.coalesce(F.expr(_COUNT).try_cast("double").cast("long"), F.lit(0))
    skipped = F.col("adjusted") | (n <= 0)
    return g.select("doc_id", skipped.alias("skipped"), F.when(skipped, 0).otherwise(n).cast("long").alias("numbers"))


@query("win10_row_height", "WITH g AS (SELECT doc_id, count(*) AS n, sum(quantity) AS fit FROM component GROUP BY doc_id) SELECT doc_id, least(greatest(25.0 * (2 * n + 1), fit, 25.0 * n) / n, 409.0)::DOUBLE AS height FROM g")
def row_height(t: Tables) -> DataFrame:
    g = t.component.groupBy("doc_id").agg(F.count("*").cast("double").alias("n"), F.sum("quantity").cast("double").alias("fit"))
    return g.select("doc_id", F.least(F.greatest(25 * (2 * F.col("n") + 1), "fit", 25 * F.col("n")) / F.col("n"), F.lit(409.0)).alias("height"))


@query("win11_family_labels", """
WITH p AS (SELECT ord, cas, name, first_value(name) OVER (PARTITION BY cas ORDER BY length(name), name) AS shortest, count(*) OVER (PARTITION BY cas) AS n FROM master)
SELECT ord, CASE WHEN n = 1 THEN 'single' WHEN name = shortest THEN 'parent' WHEN contains(name, substr(shortest, 1, 4)) THEN 'child' ELSE 'synonym' END AS label FROM p""")
def family_labels(t: Tables) -> DataFrame:
    """The shortest name of a number is the parent, ties by name."""
    heads = t.master.groupBy("cas").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("shortest"), F.count("*").alias("n"))
    label = F.when(F.col("n") == 1, "single").when(F.col("name") == F.col("shortest"), "parent").when(F.contains("name", F.substring("shortest", 1, 4)), "child").otherwise("synonym")
    return t.master.join(heads, "cas").select("ord", label.alias("label"))


_SIBLING = "CASE ord % 7 WHEN 4 THEN concat('Salt ', cas) WHEN 5 THEN CASE WHEN ord % 2 = 0 THEN concat('Salt ', cas, ' dust') ELSE 'a much longer synonym' END WHEN 6 THEN CASE WHEN ord % 3 = 0 THEN concat('Salt ', cas, ' fume') ELSE 'another much longer synonym' END ELSE concat('x', CAST(ord AS STRING)) END"
_SIBLING_CAS = "CASE WHEN (ord - ord % 7) % 49 = 0 AND ord % 7 > 3 THEN '14807-96-6' ELSE cas END"


@query("win12_parent_to_child", f"""
WITH m AS (SELECT ord, {_SIBLING_CAS} AS cas, {_SIBLING} AS name FROM master), p AS (SELECT cas, min_by(name, (length(name), name)) AS parent FROM m GROUP BY cas),
k AS (SELECT p.cas, p.parent, min(m.name) AS child, count(DISTINCT m.name) AS n FROM p JOIN m USING (cas) WHERE m.name <> p.parent AND contains(m.name, p.parent) GROUP BY ALL)
SELECT m.ord, coalesce(k.child, m.name) AS name FROM m LEFT JOIN k ON k.cas = m.cas AND k.parent = m.name AND k.n = 1 AND k.cas <> '14807-96-6'""")
def parent_to_child(t: Tables) -> DataFrame:
    """An item that is the shortest name of its number becomes the one sibling that carries this name, if there is just one; one number is exempt."""
    m = t.master.selectExpr("ord", f"{_SIBLING_CAS} AS cas", f"{_SIBLING} AS name")
    p = m.groupBy("cas").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("parent"))
    children = m.select("cas", "name").distinct().join(p.where("cas <> '14807-96-6'"), "cas").where((F.col("name") != F.col("parent")) & F.contains("name", F.col("parent")))
    one = children.groupBy("cas", F.col("parent")).agg(F.count("*").alias("n"), F.min("name").alias("child")).where("n = 1").select("cas", F.col("parent").alias("name"), "child")
    return m.join(one, ["cas", "name"], "left").select("ord", F.coalesce("child", "name").alias("name"))


@query("win13_anchor_relations", """
WITH a AS (SELECT cas, ord, first_value(ord) OVER (PARTITION BY cas ORDER BY sort_code, ord) AS anchor FROM master WHERE active) SELECT anchor AS source, ord AS target FROM a WHERE ord <> anchor""")
def anchor_relations(t: Tables) -> DataFrame:
    """From the first active profile of a number to each other active one."""
    active = t.master.where("active")
    anchors = active.groupBy("cas").agg(F.min_by("ord", F.struct("sort_code", "ord")).alias("source"))
    return active.join(anchors, "cas").where("ord <> source").select("source", F.col("ord").alias("target"))


@query("win14_parent_edges", """
WITH p AS (SELECT cas, min(ord) AS parent_id FROM master WHERE parent GROUP BY cas HAVING count(*) = 1) SELECT p.parent_id, m.ord AS child FROM master m JOIN p USING (cas) WHERE m.active AND NOT m.parent""")
def parent_edges(t: Tables) -> DataFrame:
    p = t.master.where("parent").groupBy("cas").agg(F.count("*").alias("n"), F.min("ord").alias("parent_id")).where("n = 1")
    return t.master.where("active AND NOT parent").join(p, "cas").select("parent_id", F.col("ord").alias("child"))


@query("win15_keep_first", "SELECT doc_id, cas, seq, content FROM component QUALIFY row_number() OVER (PARTITION BY doc_id, cas ORDER BY seq) = 1")
def keep_first(t: Tables) -> DataFrame:
    return t.component.groupBy("doc_id", "cas").agg(F.min(F.struct("seq", "content")).alias("x")).select("doc_id", "cas", "x.seq", "x.content")


@query("win16_context", "SELECT doc_id, seq, array_to_string(list_sort(list_distinct(list(content) OVER (PARTITION BY doc_id ORDER BY seq, content ROWS BETWEEN 2 PRECEDING AND 12 FOLLOWING))), '|') AS context FROM component")
def context(t: Tables) -> DataFrame:
    """The different lines from two above to twelve below, in order of their texts."""
    frame = W.partitionBy("doc_id").orderBy("seq", "content").rowsBetween(-2, 12)
    return t.component.select("doc_id", "seq", F.array_join(F.array_sort(F.array_distinct(F.collect_list("content").over(frame))), "|").alias("context"))


@query("win17_polymer_context", f"""
WITH {_LINES}, k AS (SELECT doc_id, page, line, bool_or(contains(text, 'polymer') OR contains(text, '고분자')) AS named, bool_or(regexp_matches(text, '(^|[^0-9-])[0-9]{{2,7}}-[0-9]{{2}}-[0-9]([^0-9-]|$)')) AS number FROM l GROUP BY ALL),
p AS (SELECT *, bool_or(named) OVER (PARTITION BY doc_id, page ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS polymer FROM k) SELECT doc_id, page, line, polymer FROM p WHERE number""")
def polymer_context(t: Tables) -> DataFrame:
    """Of each line with a number whether a polymer is named within three lines of it."""
    named = F.contains("text", F.lit("polymer")) | F.contains("text", F.lit("고분자"))
    k = visual_lines(t.word).groupBy("doc_id", "page", "line").agg(F.bool_or(named).alias("named"), F.bool_or(F.col("text").rlike(C.TOKEN)).alias("number"))
    around = W.partitionBy("doc_id", "page").orderBy("line").rowsBetween(-3, 3)
    return k.withColumn("polymer", F.bool_or("named").over(around)).where("number").select("doc_id", "page", "line", "polymer")


def retained(runs_: Column, limit: int, most: int, now: int, age: int) -> Column:
    """The runs (newest first) that are kept: a run that is dropped does not use up the budget."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("kept"))

    def step(a: Column, r: Column) -> Column:
        fits = (a["n"] < most) & (F.lit(now) - r["day"] <= age) & (a["used"] + r["size"] <= limit)
        return F.struct(
            F.when(fits, a["used"] + r["size"]).otherwise(a["used"]).alias("used"), (a["n"] + 1).alias("n"),
            F.when(fits, F.concat(a["kept"], F.array(r["id"]))).otherwise(a["kept"]).alias("kept"),
        )

    return F.aggregate(runs_, start, step)["kept"]


@query("win18_retention")
def retention(t: Tables) -> DataFrame:
    """Twenty stages of each trace are its runs; a bounded list in a row, folded in order."""
    run = F.struct((-F.col("last")).alias("order"), F.col("last").alias("id"), F.col("bytes").alias("size"), (F.col("last") % 40).alias("day"))
    runs_ = t.journal.groupBy("trace_id", "stage").agg(F.max("seq").alias("last"), F.sum("size").alias("bytes")).groupBy("trace_id").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    return runs_.select("trace_id", retained(F.col("runs"), 120_000, 5, 40, 30).alias("kept"))


@query("win19_queue", """
WITH q AS (SELECT doc_id, day, chars, row_number() OVER (PARTITION BY day ORDER BY CASE doc_type WHEN 'text' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END, doc_id) AS position, count(*) OVER (PARTITION BY day) AS queued FROM document)
SELECT doc_id, position, queued, CASE WHEN chars % 10 = 0 THEN 0.0 ELSE round(greatest(0.0, position * 30.125 - chars), 3) END::DOUBLE AS wait_seconds FROM q""")
def queue(t: Tables) -> DataFrame:
    """A day's run: place and length of its queue, and how long a document waited since it was queued (0 where that is not known)."""
    rank = F.when(F.col("doc_type") == "text", 0).when(F.col("doc_type") == "mixed", 1).otherwise(2)
    by = W.partitionBy("day")
    rows = t.document.select("doc_id", "chars", F.row_number().over(by.orderBy(rank, "doc_id")).cast("long").alias("position"), F.count("*").over(by).alias("queued"))
    wait = F.when(F.col("chars") % 10 == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.col("position") * 30.125 - F.col("chars")), 3))
    return rows.select("doc_id", "position", "queued", wait.alias("wait_seconds"))


@query("win20_forward_fill", "SELECT doc_id, seq, last_value(CASE WHEN seq % 3 = 0 THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS name FROM component")
def forward_fill(t: Tables) -> DataFrame:
    shown = F.when(F.col("seq") % 3 == 0, F.col("name"))
    return t.component.select("doc_id", "seq", F.last(shown, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)).alias("name"))


# Sorting, limits and top-k. Results are sets of rows with their positions, so that a comparison does not depend on row order.


@query("srt01_document_order", "SELECT file_hash, doc_id, row_number() OVER (PARTITION BY file_hash ORDER BY CASE doc_type WHEN 'text' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END, doc_id) AS position FROM document")
def document_order(t: Tables) -> DataFrame:
    rank = F.element_at(F.create_map(*map(F.lit, ("text", 0, "mixed", 1, "image", 2))), F.col("doc_type"))
    return t.document.select("file_hash", "doc_id", F.row_number().over(W.partitionBy("file_hash").orderBy(rank, "doc_id")).cast("long").alias("position"))


def natural_key(text: Column) -> Column:
    """Digit runs compare as numbers, the rest in lower case."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


@query("srt02_natural_sort", "SELECT process, file_name, doc_id, row_number() OVER (PARTITION BY process ORDER BY array_to_string(list_transform(regexp_extract_all(file_name, '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 20, '0') ELSE lower(p) END), ''), doc_id) AS position FROM document")
def natural_sort(t: Tables) -> DataFrame:
    return t.document.select("process", "file_name", "doc_id", F.row_number().over(W.partitionBy("process").orderBy(natural_key(F.col("file_name")), "doc_id")).cast("long").alias("position"))


@query("srt03_profile_sort", "SELECT ord, cas, row_number() OVER (PARTITION BY cas ORDER BY NOT active, parent, coalesce(nullif(sort_code, ''), '~'), name, ord) AS position FROM master")
def profile_sort(t: Tables) -> DataFrame:
    w = W.partitionBy("cas").orderBy(~F.col("active"), "parent", F.coalesce(F.nullif("sort_code", F.lit("")), F.lit("~")), "name", "ord")
    return t.master.select("ord", "cas", F.row_number().over(w).cast("long").alias("position"))


@query("srt04_method_priority", f"WITH {D.values_sql('p', 'method, rank', tuple((m, n) for n, m in enumerate(D.METHODS)))} SELECT m.ord, coalesce(p.rank, 9999) AS rank FROM roster m LEFT JOIN p USING (method)")
def method_priority(t: Tables) -> DataFrame:
    """A priority table; what it lacks goes last."""
    p = D.table(t.spark, "method string, rank int", tuple((m, n) for n, m in enumerate(D.METHODS)))
    return t.roster.join(F.broadcast(p), "method", "left").select("ord", F.coalesce("rank", F.lit(D.UNKNOWN_METHOD)).alias("rank"))


@query("srt05_substance_order", "WITH f AS (SELECT cas, min(ord) AS ord FROM master GROUP BY cas) SELECT c.doc_id, c.seq, coalesce(f.ord, 999999) AS rank FROM component c LEFT JOIN f USING (cas)")
def substance_order(t: Tables) -> DataFrame:
    f = t.master.groupBy("cas").agg(F.min("ord").alias("ord"))
    return t.component.join(f, "cas", "left").select("doc_id", "seq", F.coalesce("ord", F.lit(999999)).alias("rank"))


@query("srt06_code_sort", "WITH k AS (SELECT ord, cas, CASE WHEN ord % 6 = 0 THEN 'ZZZZZZ' ELSE sort_code END AS code FROM master) SELECT ord, row_number() OVER (PARTITION BY cas ORDER BY code, ord) AS position FROM k")
def code_sort(t: Tables) -> DataFrame:
    code = F.when(F.col("ord") % 6 == 0, "ZZZZZZ").otherwise(F.col("sort_code"))
    return t.master.select("ord", F.row_number().over(W.partitionBy("cas").orderBy(code, "ord")).cast("long").alias("position"))


@query("srt07_best_score", "SELECT doc_id, seq, quantity AS score FROM component QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quantity DESC, seq) = 1")
def best_score(t: Tables) -> DataFrame:
    return t.component.groupBy("doc_id").agg(F.max(F.struct(F.col("quantity").alias("score"), (-F.col("seq")).alias("s"))).alias("x")).select("doc_id", (-F.col("x.s")).alias("seq"), "x.score")


@query("srt08_best_attempt", """
WITH a AS (SELECT trace_id, seq, cents, count(*) FILTER (WHERE cents > 9000) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS accepted FROM journal)
SELECT trace_id, seq, cents FROM a WHERE accepted = 0 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY cents DESC, seq) = 1""")
def best_attempt(t: Tables) -> DataFrame:
    """Attempts up to the first accepted one, and of these the best."""
    first = t.journal.groupBy("trace_id").agg(F.min(F.when(F.col("cents") > 9000, F.col("seq"))).alias("stop"))
    tried = t.journal.join(first, "trace_id").where("stop IS NULL OR seq <= stop")
    return tried.groupBy("trace_id").agg(F.max(F.struct("cents", (-F.col("seq")).alias("s"))).alias("x")).select("trace_id", (-F.col("x.s")).alias("seq"), "x.cents")


@query("srt09_first_k", "SELECT doc_id, seq FROM component QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) <= 3")
def first_k(t: Tables) -> DataFrame:
    return t.component.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))).where("n <= 3").select("doc_id", "seq")


#: Tokens of images, the most wanted first.
IMAGE_PRIORITY = ("section3_crop", "sandwich_crop", "recon_ocr", "overlay", "table", "section3_page")
_IMAGE = "concat(" + D.choose_sql("seq + trace_id", (*IMAGE_PRIORITY, "photo", "scan")) + ", '_', CAST(seq AS STRING), '.png')"
_IMAGE_RANK = "CASE " + " ".join(f"WHEN contains(name, '{w}') THEN {n}" for n, w in enumerate(IMAGE_PRIORITY)) + " ELSE 99 END"


@query("srt10_priority_images", f"""
WITH i AS (SELECT trace_id, {_IMAGE} AS name FROM journal) SELECT trace_id, name FROM i QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY {_IMAGE_RANK}, name) <= 10""")
def priority_images(t: Tables) -> DataFrame:
    """Ten images of each trace: by the first token that the name holds, then by name."""
    images = t.journal.select("trace_id", F.expr(_IMAGE).alias("name"))
    order = W.partitionBy("trace_id").orderBy(F.expr(_IMAGE_RANK), "name")
    return images.withColumn("n", F.row_number().over(order)).where("n <= 10").drop("n")


@query("srt11_nearest", "SELECT doc_id, page, id, x0 FROM word QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY abs(x0 - 200), id) = 1")
def nearest(t: Tables) -> DataFrame:
    return t.word.groupBy("doc_id", "page").agg(F.min(F.struct(F.abs(F.col("x0") - 200).alias("d"), "id", "x0")).alias("x")).select("doc_id", "page", "x.id", "x.x0")


@query("srt12_longest_first", "SELECT cas, ord, row_number() OVER (PARTITION BY cas ORDER BY length(name) DESC, ord) AS position FROM master")
def longest_first(t: Tables) -> DataFrame:
    return t.master.select("cas", "ord", F.row_number().over(W.partitionBy("cas").orderBy(F.length("name").desc(), "ord")).cast("long").alias("position"))


# Set operations.


@query("set01_union_gate", """
WITH u AS (SELECT doc_id, cas, seq, content FROM component WHERE engine = 'table' UNION ALL SELECT doc_id, cas, seq + 10000000000, content FROM component WHERE engine = 'density')
SELECT doc_id, cas, content FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, cas ORDER BY CASE WHEN contains(content, '~') THEN 0 WHEN content NOT IN ('', '미기재%') THEN 1 ELSE 2 END, seq) = 1""")
def union_gate(t: Tables) -> DataFrame:
    from .aggregates import gate_lock

    c = t.component.select("doc_id", "cas", "seq", "content", "engine")
    both = c.where("engine = 'table'").unionByName(c.where("engine = 'density'").withColumn("seq", F.col("seq") + 10_000_000_000)).drop("engine")
    return gate_lock(both).select("doc_id", "cas", "content")


@query("set02_union_hits", "SELECT ord FROM master WHERE special UNION SELECT ord FROM master WHERE contains(name, 'ring')")
def union_hits(t: Tables) -> DataFrame:
    return t.master.where("special").select("ord").union(t.master.where(F.contains("name", F.lit("ring"))).select("ord")).distinct()


@query("set03_except", "SELECT cas FROM component EXCEPT SELECT cas FROM master")
def except_(t: Tables) -> DataFrame:
    return t.component.select("cas").subtract(t.master.select("cas"))


@query("set04_intersect", "SELECT cas FROM component INTERSECT SELECT cas FROM master WHERE active")
def intersect(t: Tables) -> DataFrame:
    return t.component.select("cas").intersect(t.master.where("active").select("cas"))


@query("set05_excluded_active", """
WITH a AS (SELECT DISTINCT d.process, c.cas FROM component c JOIN document d USING (doc_id)), x AS (SELECT DISTINCT process, cas FROM a JOIN (SELECT DISTINCT cas FROM master WHERE exam) USING (cas))
SELECT x.process, x.cas FROM x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.process = x.process AND a.cas = x.cas AND length(a.cas) > 9)""")
def excluded_active(t: Tables) -> DataFrame:
    a = t.component.select("doc_id", "cas").join(t.document.select("doc_id", "process"), "doc_id").select("process", "cas").distinct()
    x = a.join(t.master.where("exam").select("cas"), "cas", "left_semi")
    return x.join(a.where(F.length("cas") > 9), ["process", "cas"], "left_anti").select("process", "cas")


@query("set06_set_equality", "SELECT doc_id, list_sort(list(DISTINCT cas) FILTER (WHERE seq % 6 <> 0)) IS NOT DISTINCT FROM list_sort(list(DISTINCT cas)) AS equal FROM component GROUP BY doc_id")
def set_equality(t: Tables) -> DataFrame:
    each = t.component.groupBy("doc_id", "cas").agg(F.bool_or(F.col("seq") % 6 != 0).alias("got"))
    return each.groupBy("doc_id").agg(F.every("got").alias("equal"))


@query("set07_valid_names", """
SELECT DISTINCT lower(regexp_replace(n, '\\s', '', 'g')) AS name FROM (SELECT name AS n FROM master UNION ALL SELECT unnest(str_split(name, ' ')) FROM master) WHERE trim(n) <> ''""")
def valid_names(t: Tables) -> DataFrame:
    names = t.master.select("name").union(t.master.select(F.explode(F.split("name", " "))))
    return names.where(F.trim("name") != "").select(F.lower(F.regexp_replace("name", r"\s", "")).alias("name")).distinct()


@query("set08_selection_union", "SELECT doc_id, cas AS item FROM component WHERE page = 1 UNION SELECT doc_id, CASE WHEN content = '' THEN '[누락]' ELSE cas END FROM component WHERE page = 2")
def selection_union(t: Tables) -> DataFrame:
    """A missing marker is added at most once."""
    chosen = t.component.where("page = 1").select("doc_id", F.col("cas").alias("item"))
    more = t.component.where("page = 2").select("doc_id", F.when(F.col("content") == "", "[누락]").otherwise(F.col("cas")).alias("item"))
    return chosen.unionByName(more).distinct()
