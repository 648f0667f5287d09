"""Readers and writers: files, sheets, caches, XML and JSON answers, and the journal.

Rendering of documents, recognition of characters, language models and network services stay outside: their results come in as
tables or columns.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..catalog import Tables, query
from ..functions import cas as C
from ..operators.windows import natural_key


def discover(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, sha256, size of the files below a folder, once each, with a key for natural order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), natural_key(name).alias("order_key")).dropDuplicates(["path"])


def missing_columns(df: DataFrame, required: list[str]) -> None:
    lost = sorted(set(required) - set(df.columns))
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("cp949", "utf-8-sig", "utf-8"), needed: str = "CAS") -> DataFrame:
    """path, row_number and a column for each name in any header, by each file's own header, in the first encoding that decodes a file whole and
    whose header holds the needed word. A file that no encoding fits is an error.

    Spark's own reader knows few encodings, so files are decoded and parsed by Arrow batches. Each file is one value: for dimensions, not for bulk data.
    """

    def parse(contents: pd.Series) -> pd.Series:
        def first(raw: bytes) -> list[dict[str, str]] | None:
            for encoding in encodings:
                try:
                    text = raw.decode(encoding).lstrip("\ufeff")
                except UnicodeDecodeError:
                    continue
                if needed in text.split("\n", 1)[0]:
                    lines = list(csv.reader(io.StringIO(text, newline="")))
                    header = [c.strip() for c in lines[0]]
                    return [dict(zip(header, header, strict=True)), *(dict(zip(header, x, strict=False)) for x in lines[1:] if any(c.strip() for c in x))]
            return None

        return contents.map(first)

    files = spark.read.format("binaryFile").load(path).select("path", F.pandas_udf(parse, "array<map<string,string>>")("content").alias("rows"))
    headers = files.select("path", F.map_keys(F.get("rows", F.lit(0))).alias("names")).orderBy("path").collect()
    if lost := [r.path for r in headers if r.names is None]:
        raise ValueError(f"no encoding of {encodings} fits {', '.join(lost)}")
    names = list(dict.fromkeys(n for r in headers for n in r.names if n))
    rows = files.select("path", F.posexplode("rows").alias("row_number", "row")).where("row_number > 0")
    return rows.select("path", "row_number", *(F.col("row")[n].alias(n) for n in names))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_with_backup(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A state file, or its last good copy. The file is parsed to its end first: one that is torn anywhere is not used."""
    state = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    try:
        state.write.format("noop").mode("overwrite").save()
        return state
    except Exception:
        return spark.read.schema(schema).json(path + ".bak")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a torn last line, or any other that is none, is left out."""
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), F.try_parse_json("value").isNotNull().alias("ok")).where("ok").select("x.*")


def write_versioned(df: DataFrame, folder: str, version: str) -> str:
    """A state table in a folder of its own, so that readers of the last one are not disturbed."""
    path = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


class SheetReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            fixed = {"source_sheet": first_sheet(z)[0]}
        for number, row in enumerate(sheet_rows(self.path), 1):
            if number == 1:
                header = row
            elif any(c.strip() for c in row):
                values = dict(zip(header, row, strict=False))
                values |= fixed
                yield tuple(number if f.name == "source_row_number" else values.get(f.name) for f in self.schema.fields)


class SheetSource(DataSource):
    """The first sheet of an .xlsx file: a header, then rows that are not blank, with their sheet and numbers.

    One file is one task. The path is opened by the task, so it has to be one that every machine can open.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        header = next(iter(sheet_rows(self.options["path"])))
        return ", ".join(f"`{h}` string" for h in header if h) + ", source_sheet string, source_row_number int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], schema)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def first_sheet(z: zipfile.ZipFile) -> tuple[str, str]:
    """Name and part of the first sheet in the workbook's order; without a workbook, of the sheet of the smallest number."""
    parts = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(z.namelist()):
        sheet = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), None)
        if sheet is not None:
            wanted = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                if r.get("Id") == wanted:
                    return sheet.get("name", ""), "xl/" + r.get("Target", "").removeprefix("/xl/")
    return parts[0].rsplit("/", 1)[1].removesuffix(".xml"), parts[0]


def sheet_rows(path: str) -> Iterator[list[str]]:
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = first_sheet(z)[1]
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_MAIN}row"):
            cells: list[str] = []
            for c in row.iter(f"{_MAIN}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [""] * (at - 1 - len(cells))
                value = c.find(f"{_MAIN}v")
                inline = "".join(x.text or "" for x in c.iter(f"{_MAIN}t"))
                cells.append(shared[int(value.text)] if c.get("t") == "s" and value is not None else inline or (value.text if value is not None else ""))
            yield cells


def ocr_lines(results: DataFrame, scale: float) -> DataFrame:
    """doc_id, page, text, confidence, x0, y0, x1, y1 of recognised lines in reading order, from JSON (column raw) of either layout: an object, or a list of
    them, with rec_texts, rec_polys (or else dt_polys) and rec_scores side by side; or a list of [points, [text, score]], or a list that holds that
    list. Entries without points of two numbers fall out; a box is the extent of its points, divided by scale."""
    v = F.try_parse_json("raw")
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    polygons, items = "array<array<double>>", "array<variant>"
    objects = F.coalesce(F.when(get(v, "$.rec_texts", items).isNotNull(), F.array(v)), F.filter(get(v, "$", items), lambda x: get(x, "$.rec_texts", items).isNotNull()))
    polys = lambda x: F.coalesce(get(x, "$.rec_polys", items), get(x, "$.dt_polys", items))
    modern = F.flatten(F.transform(F.filter(objects, lambda x: polys(x).isNotNull()), lambda x: F.transform(
        F.slice(F.arrays_zip(get(x, "$.rec_texts", items).alias("t"), polys(x).alias("p"), F.coalesce(get(x, "$.rec_scores", items), F.array().cast(items)).alias("s")), F.lit(1), F.least(F.size(get(x, "$.rec_texts", items)), F.size(polys(x)))),
        lambda z: F.struct(get(z["t"], "$", "string").alias("text"), get(z["s"], "$", "double").alias("confidence"), get(z["p"], "$", polygons).alias("poly")),
    )))
    wrapped = get(v, "$[0][0][0][0][0]", "double").isNotNull()
    classic = F.transform(F.when(wrapped, get(v, "$[0]", items)).otherwise(get(v, "$", items)), lambda x: F.struct(
        F.coalesce(get(x, "$[1][0]", "string"), get(x, "$[1]", "string")).alias("text"), get(x, "$[1][1]", "double").alias("confidence"), get(x, "$[0]", polygons).alias("poly"),
    ))
    rows = results.select("doc_id", "page", F.explode(F.when(F.size(objects) > 0, modern).otherwise(classic)).alias("r")).select("doc_id", "page", "r.*")
    rows = rows.where("text IS NOT NULL AND size(poly) > 0 AND forall(poly, p -> size(p) >= 2 AND p[0] IS NOT NULL AND p[1] IS NOT NULL)")
    side = lambda f, i: (f(F.transform("poly", lambda p: p[i])) / scale)
    return rows.select("doc_id", "page", "text", "confidence", side(F.array_min, 0).alias("x0"), side(F.array_min, 1).alias("y0"), side(F.array_max, 0).alias("x1"), side(F.array_max, 1).alias("y1"))


_XML = "header struct<resultCode:string>, body struct<items:struct<item:array<struct<chemId:string, chemNameKor:string, msdsItemNameKor:string, itemDetail:string>>>>"


def _answers(answers: DataFrame) -> DataFrame:
    return answers.select("key", F.from_xml("xml", _XML, {"rowTag": "response"}).alias("x")).where("x.header.resultCode = '00'")


def regulator_first(answers: DataFrame) -> DataFrame:
    """key, chem_id, name: the first item of list answers whose result code is 00."""
    return _answers(answers).select("key", F.get("x.body.items.item", F.lit(0)).alias("i")).where("i IS NOT NULL").select("key", F.col("i.chemId").alias("chem_id"), F.col("i.chemNameKor").alias("name"))


def regulator_items(answers: DataFrame) -> DataFrame:
    """key, name, detail of detail answers whose result code is 00."""
    return _answers(answers).select("key", F.explode("x.body.items.item").alias("i")).select("key", F.col("i.msdsItemNameKor").alias("name"), F.col("i.itemDetail").alias("detail"))


def tree_texts(trees: DataFrame) -> DataFrame:
    """doc_id, page, place, text of the elements of JSON trees (column json) that nest to any depth through kids; an element without a page has that
    of the one that holds it. No built-in function descends to an unknown depth, so trees are walked in Arrow batches."""

    def walk(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[dict]:
            out: list[dict] = []
            todo = [(json.loads(text), None)]
            while todo:
                node, page = todo.pop()
                page = node.get("page", page)
                if node.get("text") is not None:
                    out.append({"page": page, "place": len(out), "text": node["text"]})
                todo += [(kid, page) for kid in reversed(node.get("kids") or [])]
            return out

        return texts.map(one)

    found = F.pandas_udf(walk, "array<struct<page:int,place:int,text:string>>")
    return trees.select("doc_id", F.explode(found("json")).alias("x")).select("doc_id", "x.*")


# The same behaviours over the carriers.


@query("src01_discovery", "SELECT file_name, count(*) AS copies FROM document WHERE regexp_matches(file_name, '\\.[pP][dD][fF]$') GROUP BY file_name")
def discovery(t: Tables) -> DataFrame:
    return t.document.where(F.col("file_name").rlike(r"\.[pP][dD][fF]$")).groupBy("file_name").agg(F.count("*").alias("copies"))


@query("src02_page_words", "SELECT doc_id, page, count(*) AS words, min(x0) AS x0, max(x0 + width) AS x1 FROM word GROUP BY doc_id, page")
def page_words(t: Tables) -> DataFrame:
    return t.word.groupBy("doc_id", "page").agg(F.count("*").alias("words"), F.min("x0").alias("x0"), F.max(F.col("x0") + F.col("width")).alias("x1"))


@query("src03_table_tree", "SELECT doc_id, page, cas AS text FROM component")
def table_tree(t: Tables) -> DataFrame:
    """Trees of pages, tables and cells, nested to different depths, written as JSON and walked."""
    leaf = F.to_json(F.struct(F.col("cas").alias("text")))
    held = lambda x: F.concat(F.lit('{"kids":['), x, F.lit("]}"))
    deep = F.when(F.col("seq") % 3 == 0, leaf).when(F.col("seq") % 3 == 1, held(leaf)).otherwise(held(held(held(leaf))))
    pages = t.component.groupBy("doc_id", "page").agg(F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit(',"kids":['), F.array_join(F.collect_list(deep), ","), F.lit("]}")).alias("p"))
    trees = pages.groupBy("doc_id").agg(held(F.array_join(F.collect_list("p"), ",")).alias("json"))
    return tree_texts(trees).select("doc_id", F.col("page").cast("long").alias("page"), "text")


@query("src04_ocr_lines", "SELECT doc_id, page, cas AS text, CASE WHEN page = 3 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS confidence, CAST(20 AS DOUBLE) AS x0, CAST(page * 10 AS DOUBLE) AS y0, CAST(60 AS DOUBLE) AS x1 FROM component")
def ocr(t: Tables) -> DataFrame:
    """Pages in one of three layouts, each with a malformed entry."""
    y = (F.col("page") * 15).cast("string")
    poly = F.concat(F.lit("[[30,"), y, F.lit("],[90,"), y, F.lit("],[90,99],[30,99]]"))
    listed = lambda x: F.concat_ws(",", F.collect_list(x))
    pages = t.component.groupBy("doc_id", "page").agg(listed(F.concat(F.lit('"'), "cas", F.lit('"'))).alias("t"), listed(poly).alias("p"), listed(F.lit("0.5")).alias("s"), listed(F.concat(F.lit("["), poly, F.lit(',["'), "cas", F.lit('",0.5]]'))).alias("old"))
    raw = F.when(F.col("page") == 1, F.concat(F.lit('[{"rec_texts":["bad",'), "t", F.lit('],"rec_polys":[[["x"]],'), "p", F.lit('],"rec_scores":[1,'), "s", F.lit("]}]"))).when(
        F.col("page") == 2, F.concat(F.lit("[["), "old", F.lit(',[null,["bad",1]]]]'))).otherwise(F.concat(F.lit('{"rec_texts":['), "t", F.lit(',"bad"],"dt_polys":['), "p", F.lit(",[]]}")))
    return ocr_lines(pages.select("doc_id", "page", raw.alias("raw")), 1.5).select("doc_id", "page", "text", "confidence", "x0", "y0", "x1")


@query("src05_sheet_rows", "SELECT ord + 2 AS source_row_number, name FROM master WHERE ord % 5 <> 0")
def sheet(t: Tables) -> DataFrame:
    """Rows of a sheet with their numbers, blank ones left out; the reader itself is tested on a file."""
    rows = t.master.select((F.col("ord") + 2).alias("source_row_number"), F.when(F.col("ord") % 5 == 0, " ").otherwise(F.col("name")).alias("name"))
    return rows.where(F.trim("name") != "")


@query("src06_required", "SELECT 'ok' AS header")
def required(t: Tables) -> DataFrame:
    missing_columns(t.master, ["cas", "name", "ord"])
    return t.spark.range(1).select(F.lit("ok").alias("header"))


@query("src07_exposure_csv", "SELECT coalesce(nullif(trim(CASE WHEN ord % 3 = 0 THEN '' ELSE cas END), ''), cas) AS key, max_by(twa, ord) AS twa FROM master GROUP BY 1")
def exposure_csv(t: Tables) -> DataFrame:
    """The key from either of two columns; of repeated keys the last wins."""
    key = F.coalesce(F.nullif(F.trim(F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("cas"))), F.lit("")), "cas")
    return t.master.groupBy(key.alias("key")).agg(F.max_by("twa", "ord").alias("twa"))


@query("src08_dataset_json", "SELECT ord AS profile_id, cas, name FROM master")
def dataset_json(t: Tables) -> DataFrame:
    text = t.master.select(F.to_json(F.struct(F.col("ord").alias("profile_id"), "cas", "name")).alias("j"))
    return text.select(F.from_json("j", "profile_id long, cas string, name string").alias("x")).select("x.*")


@query("src09_first_master", "SELECT cas, min(ord) AS ord FROM master WHERE regexp_matches(cas, '^[0-9]{2,7}-[0-9]{2}-[0-9]$') GROUP BY cas")
def first_master(t: Tables) -> DataFrame:
    return t.master.where(C.well_formed(F.col("cas"))).groupBy("cas").agg(F.min("ord").alias("ord"))


@query("src10_last_name", "SELECT cas, max_by(CASE WHEN ord % 4 = 0 THEN 'trade ' || CAST(ord AS STRING) ELSE name END, ord) AS name FROM master GROUP BY cas")
def last_name(t: Tables) -> DataFrame:
    name = F.coalesce(F.when(F.col("ord") % 4 != 0, F.col("name")), F.concat(F.lit("trade "), F.col("ord").cast("string")))
    return t.master.groupBy(C.strip_zeros(F.concat(F.lit("00"), "cas")).alias("cas")).agg(F.max_by(name, "ord").alias("name"))


@query("src11_regulator_xml", "SELECT cas AS key, CAST(ord AS STRING) AS chem_id, name FROM master WHERE ord % 3 <> 0")
def regulator_xml(t: Tables) -> DataFrame:
    """Of list answers the first item, of those with a good code."""
    code = F.when(F.col("ord") % 3 == 0, "99").otherwise("00")
    item = lambda i, n: F.concat(F.lit("<item><chemId>"), i, F.lit("</chemId><chemNameKor>"), n, F.lit("</chemNameKor></item>"))
    xml = F.concat(F.lit("<response><header><resultCode>"), code, F.lit("</resultCode></header><body><items>"), item(F.col("ord").cast("string"), F.col("name")), item(F.lit("second"), F.lit("x")), F.lit("</items></body></response>"))
    return regulator_first(t.master.select(F.col("cas").alias("key"), xml.alias("xml")))


@query("src12_journal", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events WHERE event_id % 9 <> 0")
def journal(t: Tables) -> DataFrame:
    torn = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    rows = t.events.select("event_id", torn.alias("value"))
    return rows.where(F.try_parse_json("value").isNotNull()).select("event_id", F.from_json("value", "k int")["k"].alias("k"))


@query("src13_fenced_json", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events")
def fenced_json(t: Tables) -> DataFrame:
    text = F.regexp_replace(F.concat(F.lit("```json "), "props", F.lit(" ```")), r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json(text), "$.k", "int").alias("k"))


@query("src14_backup", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'backup' ELSE 'primary' END AS origin FROM events")
def backup(t: Tables) -> DataFrame:
    """Row-wise: the primary value if it parses, else the copy."""
    primary = F.when(F.col("event_id") % 11 == 0, "{torn").otherwise(F.col("props"))
    return t.events.select("event_id", F.when(F.try_parse_json(primary).isNotNull(), "primary").otherwise("backup").alias("origin"))


@query("src15_fingerprint", "SELECT event_id, sha256(props) AS sha256 FROM events")
def fingerprint(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.sha2("props", 256).alias("sha256"))


@query("snk01_dataset_order", "SELECT ord, row_number() OVER (PARTITION BY substr(sort_code, 1, 2) ORDER BY sort_code, name, ord) AS position FROM master")
def dataset_order(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    w = W.partitionBy(F.substring("sort_code", 1, 2)).orderBy("sort_code", "name", "ord")
    return t.master.select("ord", F.row_number().over(w).cast("long").alias("position"))


@query("snk07_run_summary", "SELECT run_id, to_json({'total': count(*), 'failures': count(*) FILTER (WHERE event = 'failure')})::VARCHAR AS summary FROM journal GROUP BY run_id")
def run_summary(t: Tables) -> DataFrame:
    counts = F.struct(F.count("*").alias("total"), F.count_if(F.col("event") == "failure").alias("failures"))
    return t.journal.groupBy("run_id").agg(F.to_json(counts).alias("summary"))


@query("src16_template_lookup", "WITH p(folder, rank) AS (VALUES (0, 0), (1, 1), (2, 2)) SELECT d.doc_id, min_by(p.folder, p.rank) AS folder FROM document d JOIN p ON (d.chars + p.folder) % 3 = 0 GROUP BY d.doc_id")
def template_lookup(t: Tables) -> DataFrame:
    """The first folder of an ordered search path that holds the template. (Carrier: each document's is in one of three.)"""
    found = F.filter(F.array(*(F.lit(i) for i in range(3))), lambda i: (F.col("chars") + i) % 3 == 0)
    return t.document.select("doc_id", F.get(found, F.lit(0)).alias("folder"))


@query("snk08_last_good", "SELECT run_id, max_by(seq, seq) AS seq, max_by(candidate, seq) AS candidate FROM journal WHERE status = 'completed' AND event <> 'failure' GROUP BY run_id")
def last_good(t: Tables) -> DataFrame:
    """Of the versions of a state the last that was written whole; half-written ones are never chosen."""
    whole = t.journal.where("status = 'completed' AND event <> 'failure'")
    return whole.groupBy("run_id").agg(F.max(F.struct("seq", "candidate")).alias("x")).select("run_id", "x.seq", "x.candidate")
