"""Cleaning of free-text substance lists, measurement plans and their numbering."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..catalog import Tables, query
from ..operators.aggregates import ordered_distinct
from ..operators.scalars import _PREFIX, regulation_prefix


def split_outside(text: Column) -> Column:
    """Parts of a list at semicolons that no bracket encloses: characters are folded with the depth, bounded by the text."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("done"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(a["done"], F.when((c == ";") & (depth == 0), "\n").otherwise(c)).alias("done"))

    folded = F.aggregate(F.split(text, ""), start, step)["done"]
    return F.filter(F.transform(F.split(folded, "\n"), lambda s: F.trim(s)), lambda s: s != "")


@query("ext12_bracket_split", "SELECT ord, string_agg(x, '|' ORDER BY i) AS parts FROM (SELECT ord, 0 AS i, name AS x FROM master UNION ALL SELECT ord, 1, '[a; b](' || cas || '; ' || twa || ')' FROM master) GROUP BY ord")
def bracket_split(t: Tables) -> DataFrame:
    text = F.concat("name", F.lit("; [a; b]("), "cas", F.lit("; "), "twa", F.lit(")"))
    return t.master.select("ord", F.array_join(split_outside(text), "|").alias("parts"))


@query("ext13_grouped_chems", f"""
WITH p AS (SELECT DISTINCT d.process, m.name, m.cas, {_PREFIX} AS category, min(c.seq) OVER (PARTITION BY d.process, m.name) AS first FROM component c JOIN document d USING (doc_id) JOIN master m USING (cas) WHERE c.quantity >= 45),
a AS (SELECT DISTINCT d.process, m.name FROM component c JOIN document d USING (doc_id) JOIN master m USING (cas) WHERE c.quantity < 3)
SELECT process, category, string_agg(name, ', ' ORDER BY first, name) AS names FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.process = p.process AND a.name = p.name) GROUP BY process, category""")
def grouped_chems(t: Tables) -> DataFrame:
    """Excluded substances by category, less those that the same process measures."""
    rows = t.component.select("doc_id", "cas", "seq", "quantity").join(t.document.select("doc_id", "process"), "doc_id").join(t.master, "cas").select("process", "name", regulation_prefix().alias("category"), "seq", "quantity")
    active = rows.where("quantity < 3").select("process", "name").distinct()
    left = rows.where("quantity >= 45").join(active, ["process", "name"], "left_anti")
    one = left.groupBy("process", "category", "name").agg(F.min("seq").alias("first"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ", ")
    return one.groupBy("process", "category").agg(names.alias("names"))


def mask_known(text: str, names: list[str]) -> str:
    """Known names are taken out of a text, in the order given; what is left is split and put behind them."""
    found = []
    for name in names:
        if name and name in text:
            found.append((text.index(name), name))
            text = text.replace(name, "\x00" * len(name))
    rest = [x.strip() for x in re.split(r"[;\n/\x00]+", text) if x.strip()]
    return "; ".join([n for _, n in sorted(found)] + list(dict.fromkeys(rest)))


#: Bits by which places of a text are told from those where no name begins, as words of 64.
SPOTS = 2**18


def mask_names(texts: DataFrame, names: DataFrame, head: int = 4) -> DataFrame:
    """texts (id, text) with clean: the names (column name) that a text holds taken out, the longest first.

    A text that holds a name holds the name's first characters: places that begin with none are dropped by bits of fixed size, the rest are cut
    to the lengths of names with those characters, and cuts and names meet as equals. So work grows with places and lengths, not with pairs of
    texts and names, and no list of names goes to each text. The masking itself goes on from name to name within a text, in Arrow batches. A null text
    stays null.
    """
    known = names.where("name <> ''").select("name", F.substring("name", 1, head).alias("key")).distinct()
    spot = F.pmod(F.xxhash64("key"), F.lit(SPOTS))
    words = known.select(F.shiftright(spot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    filled = texts.sparkSession.range(SPOTS // 64).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    bits = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()
    sizes = known.agg(F.array_sort(F.collect_set(F.length("key")))).scalar()
    heads = known.groupBy("key").agg(F.collect_set(F.length("name")).alias("lengths"))
    sized = texts.where("text <> ''").select("id", "text", F.explode(sizes).alias("size")).where(F.length("text") >= F.col("size"))
    places = sized.select("id", "text", "size", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1)).alias("at"))
    begun = places.select("id", "text", "at", F.substr("text", "at", "size").alias("key")).where(F.getbit(F.get(bits, F.shiftright(spot, 6).cast("int")), (spot % 64).cast("int")) == 1)
    cuts = begun.join(heads, "key").select("id", "text", "at", F.explode("lengths").alias("length")).where(F.col("at") + F.col("length") - 1 <= F.length("text"))
    held = cuts.select("id", F.substr("text", "at", "length").alias("name")).join(known.select("name"), "name")
    order = F.struct((-F.length("name")).alias("n"), "name")
    lists = held.groupBy(F.col("id").alias("of")).agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["name"]).alias("names"))

    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask_known(t, [] if n is None else list(n)) for t, n in zip(texts, names, strict=True)], dtype=object)

    return texts.join(lists, F.col("id").eqNullSafe(F.col("of")), "left").select("id", F.pandas_udf(run, "string")("text", "names").alias("clean"))


@query("ext14_greedy_mask")
def greedy_mask(t: Tables) -> DataFrame:
    text = F.concat("name", F.lit("/extra; "), "name", F.lit("; "), "cas")
    return mask_names(t.master.select(F.col("ord").alias("id"), text.alias("text")), t.part.select(F.col("p_name").alias("name"))).withColumnRenamed("id", "ord")


@query("ext15_substance_cleaning", f"""
WITH f AS (SELECT cas, min_by(name, ord) AS name, min(ord) AS ord, bool_or(special) AS special, bool_or(permit) AS permit, bool_or(exam) AS exam, bool_or(measured) AS measured FROM master GROUP BY cas),
j AS (SELECT DISTINCT d.process, c.cas FROM component c JOIN document d USING (doc_id) WHERE c.quantity >= 20), w AS (SELECT DISTINCT d.process, c.cas FROM component c JOIN document d USING (doc_id) WHERE c.quantity < 40),
r AS (SELECT j.process, coalesce(f.ord, 999999) AS rank, CASE WHEN w.cas IS NULL THEN '[누락]' ELSE '' END || coalesce({_PREFIX} || f.name, j.cas) AS item FROM j LEFT JOIN f USING (cas) LEFT JOIN w ON w.process = j.process AND w.cas = j.cas),
u AS (SELECT DISTINCT process, rank, item FROM r)
SELECT process, string_agg(item, '; ' ORDER BY rank, item) AS cleaned, count(*) AS items, count(*) FILTER (WHERE starts_with(item, '[누락]')) AS missing FROM u GROUP BY process""")
def substance_cleaning(t: Tables) -> DataFrame:
    """Names are corrected by number, marked by regulation, deduplicated, marked where the plan lacks them, sorted and put together."""
    rows = t.component.select("doc_id", "cas", "quantity").join(t.document.select("doc_id", "process"), "doc_id")
    each = rows.groupBy("process", "cas").agg(F.bool_or(F.col("quantity") >= 20).alias("listed"), F.bool_or(F.col("quantity") < 40).alias("planned")).where("listed")
    f = t.master.groupBy("cas").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"), *(F.bool_or(c).alias(c) for c in ("special", "permit", "exam", "measured")))
    item = F.concat(F.when(F.col("planned"), "").otherwise("[누락]"), F.coalesce(F.concat(regulation_prefix(), "name"), "cas"))
    items = each.join(f, "cas", "left").select("process", F.coalesce("ord", F.lit(999999)).alias("rank"), item.alias("item")).distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), "; ")
    return items.groupBy("process").agg(text.alias("cleaned"), F.count("*").alias("items"), F.count_if(F.startswith("item", F.lit("[누락]"))).alias("missing"))


@query("ext16_measurement_plan", """
WITH m AS (SELECT cas, min_by(name, ord) AS name, min_by(method, ord) AS method, min(ord) AS ord FROM master WHERE method <> 'M0' GROUP BY cas), x AS (SELECT d.process, m.method, m.name, m.ord, min(c.seq) AS first FROM component c JOIN document d USING (doc_id) JOIN m USING (cas) GROUP BY ALL)
SELECT process, method, string_agg(name, ', ' ORDER BY ord, name) AS substances, CASE WHEN count(*) = 1 THEN '(단)' ELSE '(다)' END AS kind, min_by(name, (ord, name)) AS representative, min(first) AS first FROM x GROUP BY process, method""")
def measurement_plan(t: Tables) -> DataFrame:
    """Substances of a process by method; one alone is single, and the first in order stands for its group."""
    m = t.master.where("method <> 'M0'").groupBy("cas").agg(F.min_by("name", "ord").alias("name"), F.min_by("method", "ord").alias("method"), F.min("ord").alias("ord"))
    rows = t.component.select("doc_id", "cas", "seq").join(t.document.select("doc_id", "process"), "doc_id").join(m, "cas")
    each = rows.groupBy("process", "method", "name", "ord").agg(F.min("seq").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "name")))
    plan = each.groupBy("process", "method").agg(ordered.alias("x"), F.min("first").alias("first"))
    return plan.select("process", "method", F.array_join(F.transform("x", lambda s: s["name"]), ", ").alias("substances"), F.when(F.size("x") == 1, "(단)").otherwise("(다)").alias("kind"), F.get("x", F.lit(0))["name"].alias("representative"), "first")


@query("ext17_numbering", """
WITH g AS (SELECT process, doc_type, count(*) AS n, bool_and(chars < 100) AS skipped FROM document GROUP BY ALL), k AS (SELECT *, CASE WHEN skipped THEN 0 ELSE n END AS takes FROM g)
SELECT process, doc_type, CASE WHEN takes > 0 THEN CAST(sum(takes) OVER (PARTITION BY process ORDER BY doc_type) - takes + 1 AS BIGINT) END AS first, CASE WHEN takes > 0 THEN CAST(sum(takes) OVER (PARTITION BY process ORDER BY doc_type) AS BIGINT) END AS last FROM k""")
def numbering(t: Tables) -> DataFrame:
    g = t.document.groupBy("process", "doc_type").agg(F.count("*").alias("n"), F.every(F.col("chars") < 100).alias("skipped"))
    takes = F.when(F.col("skipped"), 0).otherwise(F.col("n"))
    upto = F.sum("takes").over(W.partitionBy("process").orderBy("doc_type"))
    return g.withColumn("takes", takes).withColumn("upto", upto).select("process", "doc_type", F.when(F.col("takes") > 0, F.col("upto") - F.col("takes") + 1).alias("first"), F.when(F.col("takes") > 0, F.col("upto")).alias("last"))


# Sinks: what is written, as rows.


@query("snk02_wide", "WITH f AS (SELECT doc_id, cas, min(seq) AS first FROM component GROUP BY ALL) SELECT doc_id, string_agg(cas, '; ' ORDER BY first, cas) AS numbers FROM f GROUP BY doc_id")
def wide(t: Tables) -> DataFrame:
    """A row for each file, component columns joined."""
    return ordered_distinct(t.component, "doc_id", "cas", "seq", "numbers")


@query("snk03_long", "SELECT doc_id, seq, cas, content, d.product, row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 AS opens FROM component JOIN document d USING (doc_id)")
def long_(t: Tables) -> DataFrame:
    """A row for each component, the file's columns repeated."""
    first = t.component.groupBy("doc_id").agg(F.min("seq").alias("first"))
    return t.component.join(first, "doc_id").join(t.document.select("doc_id", "product"), "doc_id").select("doc_id", "seq", "cas", "content", "product", (F.col("seq") == F.col("first")).alias("opens"))


@query("snk04_mapped", "SELECT doc_id AS A, product AS C, status AS AB FROM document")
def mapped(t: Tables) -> DataFrame:
    """Logical fields under spreadsheet letters."""
    return t.document.select(*(F.col(c).alias(a) for c, a in (("doc_id", "A"), ("product", "C"), ("status", "AB"))))


@query("snk05_collapse", r"SELECT doc_id, product || ' x' AS a FROM document")
def collapse(t: Tables) -> DataFrame:
    return t.document.select("doc_id", F.regexp_replace(F.concat("product", F.lit(" \n\n  x")), r"\s{2,}", " ").alias("a"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@query("snk06_report", """SELECT doc_id, '<ul>' || string_agg('<li>' || cas || ' ' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</li>', '' ORDER BY seq) || '</ul>' AS html FROM component GROUP BY doc_id""")
def report(t: Tables) -> DataFrame:
    line = F.concat(F.lit("<li>"), "cas", F.lit(" "), escape_html(F.col("content")), F.lit("</li>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "")
    return t.component.groupBy("doc_id").agg(F.concat(F.lit("<ul>"), lines, F.lit("</ul>")).alias("html"))


@query("snk09_share_manifest", "SELECT run_id, count(*) AS files, sha256(string_agg(CAST(seq AS STRING), ',' ORDER BY seq)) AS digest, CAST(sum(size) AS BIGINT) AS bytes FROM journal WHERE status = 'completed' AND seq % 20 = 0 GROUP BY run_id")
def share_manifest(t: Tables) -> DataFrame:
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("seq")), lambda s: s.cast("string")), ",")
    return t.journal.where("status = 'completed' AND seq % 20 = 0").groupBy("run_id").agg(F.count("*").alias("files"), F.sha2(ids, 256).alias("digest"), F.sum("size").alias("bytes"))


@query("snk10_padded", "SELECT ord, '| ' || name || repeat(' ', greatest(CAST(40 - length(name) AS INTEGER), 0)) || ' | [특별]' || repeat(' ', 2) || ' |' AS line FROM master")
def padded(t: Tables) -> DataFrame:
    """A table line padded by display width: wide characters count two."""
    width = lambda c: F.length(c) + F.length(F.regexp_replace(c, r"[^\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]", ""))
    pad = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(n) - width(c), F.lit(0))))
    return t.master.select("ord", F.concat(F.lit("| "), pad(F.col("name"), 40), F.lit(" | "), pad(F.lit("[특별]"), 8), F.lit(" |")).alias("line"))


@query("snk11_rename", "SELECT doc_id, file_name, lpad(CAST(row_number() OVER (PARTITION BY process ORDER BY file_name, doc_id) AS STRING), 3, '0') || '_' || regexp_replace(file_name, '^[0-9]+[_ .-]*', '') AS renamed FROM document WHERE chars < 200")
def rename(t: Tables) -> DataFrame:
    """A plan of old and new names; nothing is renamed here."""
    n = F.row_number().over(W.partitionBy("process").orderBy("file_name", "doc_id")).cast("string")
    return t.document.where("chars < 200").select("doc_id", "file_name", F.concat(F.lpad(n, 3, "0"), F.lit("_"), F.regexp_replace("file_name", r"^[0-9]+[_ .-]*", "")).alias("renamed"))


@query("snk12_number_conflicts", "WITH o AS (SELECT DISTINCT chars AS cell FROM document WHERE doc_id % 50 = 0) SELECT d.doc_id, d.chars AS cell FROM document d WHERE doc_id % 50 <> 0 AND d.chars IN (SELECT cell FROM o)")
def number_conflicts(t: Tables) -> DataFrame:
    """Cells that are already occupied."""
    occupied = t.document.where("doc_id % 50 = 0").select(F.col("chars").alias("cell"))
    return t.document.where("doc_id % 50 <> 0").select("doc_id", F.col("chars").alias("cell")).join(occupied, "cell", "left_semi").select("doc_id", "cell")
