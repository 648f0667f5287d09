import json
import zipfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from assayloom.sources import readers
from assayloom.streaming import journal


def test_sheet(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [cell("A1", "name") + cell("C1", "cas"), cell("A2", "x") + cell("C2", "64-17-5"), cell("A3", " "), '<c r="C4"><v>7</v></c>']
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>")
    spark.dataSource.register(readers.SheetSource)
    got = spark.read.format("sheet").option("path", path).load().collect()
    assert [(r["name"], r["cas"], r.source_sheet, r.source_row_number) for r in got] == [("x", "64-17-5", "sheet1", 2), ("", "7", "sheet1", 4)]


def test_first_sheet_is_the_workbooks(spark, tmp_path):
    path, ns = str(tmp_path / "b.xlsx"), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda v: f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>h</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    parts = {f"xl/worksheets/sheet{n}.xml": sheet(f"s{n}") for n in (10, 2)}
    for book, want in ((None, ("sheet2", "s2")), ("master", ("master", "s10"))):
        with zipfile.ZipFile(path, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
            if book:
                z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="urn:r"><sheets><sheet name="{book}" r:id="r7"/><sheet name="other" r:id="r8"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r8" Target="worksheets/sheet2.xml"/><Relationship Id="r7" Target="worksheets/sheet10.xml"/></Relationships>')
        with zipfile.ZipFile(path) as z:
            assert readers.first_sheet(z)[0] == want[0]
        assert list(readers.sheet_rows(path))[1] == [want[1]]


def test_csv_encodings(spark, tmp_path):
    for encoding in ("cp949", "utf-8"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes("CAS No,명칭\n64-17-5,에탄올\n".encode(encoding))
        assert readers.read_csv(spark, str(path)).first()["명칭"] == "에탄올"


def test_csv_headers_are_each_files_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,CAS No\nx,64-17-5\n\n")
    (tmp_path / "b.csv").write_text('CAS No,name,limit\n67-64-1,"y, z",5\n', encoding="utf-8-sig")
    got = {(r["CAS No"], r["name"], r["limit"], r.row_number) for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {("64-17-5", "x", None, 1), ("67-64-1", "y, z", "5", 1)}
    (tmp_path / "c.csv").write_text("no header\n1\n")
    with pytest.raises(ValueError, match="c.csv"):
        readers.read_csv(spark, str(tmp_path))


def test_backup_is_used_wherever_the_file_is_torn(spark, tmp_path):
    path = str(tmp_path / "state.json")
    for name, rows, tail in ((path, 5, '{"k": '), (path + ".bak", 9, "")):
        with open(name, "w") as f:
            f.write("".join(f'{{"k": {i}}}\n' for i in range(rows)) + tail)
    assert readers.read_with_backup(spark, path, "k int").count() == 9


def test_discovery_and_missing_columns(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("10.pdf", "b/2.PDF", "x.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = readers.discover(spark, str(tmp_path)).orderBy("order_key").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["2.PDF", "10.pdf"]
    try:
        readers.missing_columns(spark.range(1), ["id", "b", "a"])
        raise AssertionError
    except ValueError as e:
        assert "a, b" in str(e)


def test_backup_and_journal(spark, tmp_path):
    path = str(tmp_path / "state.json")
    for name, text in ((path, '{"k": '), (path + ".bak", '{"k": 1}')):
        with open(name, "w") as f:
            f.write(text)
    assert readers.read_with_backup(spark, path, "k int").first().k == 1
    with open(path, "w") as f:
        f.write('{"k": 1}\n{"k": 2}\n{"k": ')
    assert [r.k for r in readers.read_journal(spark, path, "k int").collect()] == [1, 2]


def test_versions(spark, tmp_path):
    a = readers.write_versioned(spark.range(2), str(tmp_path), "1")
    assert spark.read.parquet(a).count() == 2


def test_ocr_layout_and_xml(spark):
    box = [[30, 150], [90, 150], [90, 195], [30, 195]]
    pages = [
        {"rec_texts": ["a", "b", "c"], "rec_polys": [box, [], [[1]]], "rec_scores": [0.9]}, [{"rec_texts": ["a"], "dt_polys": [box, box], "rec_scores": [0.9]}, {"other": 1}],
        [[box, ["a", 0.9]], [None, ["b", 1]], "odd"], [[[box, ["a", 0.9]], [[["x", 1]], ["b", 1]]]], [], "text",
    ]
    df = spark.createDataFrame([(i, 1, json.dumps(p)) for i, p in enumerate(pages)] + [(9, 1, None)], "doc_id long, page int, raw string")
    got = sorted((r.doc_id, r.text, r.confidence, r.x0, r.y0, r.x1, r.y1) for r in readers.ocr_lines(df, 1.5).collect())
    assert got == [(i, "a", 0.9, 20.0, 100.0, 60.0, 130.0) for i in range(4)]
    xml = "<response><header><resultCode>{}</resultCode></header><body><items><item><msdsItemNameKor>n</msdsItemNameKor><itemDetail>d</itemDetail></item></items></body></response>"
    got = readers.regulator_items(spark.createDataFrame([("a", xml.format("00")), ("b", xml.format("99"))], "key string, xml string")).collect()
    assert [tuple(r) for r in got] == [("a", "n", "d")]


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").where(F.col("event_id") < 400)
    late = events.agg(F.max("ts")).first()[0]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events.unionByName(events.where("event_id % 3 = 0")).repartition(1).write.parquet(source)
    stream = journal.stream_journal(spark, source, delay="400 days")
    q = journal.window_counts(stream).writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = stream.writeStream.outputMode("append").format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("seen").count() == events.count()
    journal.run_counts(spark.readStream.schema(journal.JOURNAL_SCHEMA).parquet(source).withWatermark("ts", "1 second"), sink, str(tmp_path / "cp"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(sink).collect()}
    whole = {(r.start, r.event_type): r.n for r in journal.window_counts(spark.read.parquet(source)).collect()}
    assert got and all(whole[k] == n for k, n in got.items())
    windows = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    assert all(whole[k] == n for k, n in windows.items())
    ended = {k: n for k, n in whole.items() if k[0] < late - timedelta(days=401)}
    assert ended.items() <= windows.items()


def test_ttl(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS at, timestamp'2024-01-01 02:00:00' AS now")
    assert tuple(df.select(journal.fresh(F.col("at"), F.col("now"), F.lit(False)), journal.fresh(F.col("at"), F.col("now"), F.lit(True))).first()) == (True, False)
