"""Components recovered from pages of words."""

import time

import pytest
from pyspark.sql import functions as F

from assayloom.operators.windows import logical_rows
from assayloom.plans import extraction, recovery
from assayloom.plans.extraction import html_rows, match_score
from assayloom.plans.recovery import recover_rows

SCHEMA = "doc_id long, page int, x0 long, y0 long, width long, height long, id long, text string"


def page(spark, lines):
    """One line: (y, words); words begin at 20, with a gap of 12."""
    rows, n = [], 0
    for y, words in lines:
        x = 20
        for w in words:
            width = max(12, 6 * len(w))
            rows.append((1, 1, x, y, width, 10, n, w))
            x, n = x + width + 12, n + 1
    return spark.createDataFrame(rows, SCHEMA)


TITLE, NEXT = (100, ["3.", "구성성분의", "명칭", "및", "함유량"]), (200, ["4.", "응급조치요령"])
CARD = [TITLE, (130, ["성분", "Ethanol"]), (150, ["CAS", "번호"]), (170, ["64-17-5"]), (190, ["함유량"]), (210, ["50%"]), (260, ["4.", "응급조치요령"])]
LONG = ["Imidazolium", "compounds,", "1-[2-(carboxymethoxy)ethyl]-1-(carboxymethyl)-4,5-dihydro-2-norcoco", "68650-39-5", "30", "-", "40"]
PAGES = [
    *(([TITLE, (140, ["Test", "64-17-5", "2", word]), NEXT], {"64-17-5": sign}) for word, sign in (("미만", "<2%"), ("이하", "≤2%"), ("이상", "≥2%"), ("초과", ">2%"))),
    ([(100, ["항", "3:", "구성성분의", "명칭", "및", "함유량"]), (140, ["Test", "64-17-5"]), (180, ["항", "4:", "응급조치요령"]), (700, ["Sigma-", "쪽", "2", "/", "10"])], {"64-17-5": "미기재%"}),
    ([(100, [*TITLE[1], "CAS번호"]), (140, ["First", "64-17-5", "1", "-", "5"]), (160, ["Second", "67-64-1"]), NEXT], {"64-17-5": "1~5%", "67-64-1": "미기재%"}),
    ([TITLE, (140, ["Test", "64-17-5", "50%", "Note"]), NEXT], {"64-17-5": "미기재%"}),
    ([TITLE, (140, ["Rev.03", "Test", "64-17-5", "50%"]), NEXT], {"64-17-5": "미기재%"}),
    ([(100, ["SECTION", "3:", "Composition"]), (140, ["Test", "64-17-5", "50%", "Note"]), (200, ["SECTION", "4:", "First", "Aid"])], {"64-17-5": "미기재%"}),
    ([TITLE, (140, ["Test", "64-17-5", "50%"]), NEXT], {"64-17-5": "50%"}),
    ([(100, ["3.", "COMPOSITION", "CAS", "NO.", "CONTENTS(%)"]), (140, LONG), (200, ["4.", "FIRST", "AID", "MEASURES"])], {"68650-39-5": "30~40%"}),
    ([TITLE, (120, ["Long", "Chemical", "Name"]), (130, ["Continuation", "Name"]), (150, ["64-17-5", "50%"]), NEXT], {"64-17-5": "50%"}),
    ([TITLE, (140, ["Test", "64-17-5", "1", "-", "5"]), NEXT], {"64-17-5": "1~5%"}),
    (CARD, {"64-17-5": "50%"}),
    ([TITLE, (140, ["Blend", "64-17-5", "67-64-1", "50%"]), NEXT], {"64-17-5": "50%", "67-64-1": "50%"}),
    ([TITLE, (140, ["Test", "64-17-5", "EC", "202-016-5"]), (220, NEXT[1])], {"64-17-5": "미기재%"}),
    ([TITLE, (140, ["Test", "64-17-5"]), (160, ["Reference", "50"]), (220, NEXT[1])], {"64-17-5": "미기재%"}),
    ([TITLE, (140, ["Test", "64-17-5", "balance"]), NEXT], {"64-17-5": "Rem.%"}),
    ([TITLE, (140, ["Acrylate", "polymer", "25767-39-9"]), (150, ["20", "45"]), NEXT], {"25767-39-9": "미기재%"}),
    ([TITLE, (120, ["styrene", "polymer"]), (140, ["Resin", "25767-39-9", "45", "20"]), NEXT], {"25767-39-9": "20~45%"}),
    ([TITLE, (110, ["3.50%"]), (140, ["Test", "64-17-5"]), NEXT], {"64-17-5": "미기재%"}),
    ([TITLE, (110, ["wt", "3.50%"]), (140, ["Test", "64-17-5"]), NEXT], {"64-17-5": "3.5%"}),
    ([(100, ["1.", "Product", "name", "64-17-5", "10%"])], {"64-17-5": "10%"}),
]


@pytest.mark.parametrize(("lines", "want"), PAGES)
def test_rows(spark, lines, want):
    assert {r.cas: r.content for r in recover_rows(page(spark, lines)).collect()} == want


def test_long_names_take_no_time():
    words = [recovery.Word(20 + 90 * i, 140, 100 + 90 * i, 150, w) for i, w in enumerate([*LONG, "1-[2-(carboxy)]-" * 300])]
    began = time.perf_counter()
    assert [x[1] for x in recovery.recover(words)] == ["68650-39-5"]
    assert time.perf_counter() - began < 0.5


def test_both_scores_agree(spark):
    """The score of the page function and the score as columns, over the surroundings of the query's rows."""
    amounts = ["50%", "2 미만", "100", "100%", "1-2-3", "200 %", "1995", "5~1995", "7.5", "3 - 4", "2004.5%"]
    leads = ["3. 구성성분 [CAS_ANCHOR] ", "[CAS_ANCHOR] ", "[CAS_ANCHOR] rev 2 ", "[CAS_ANCHOR] concentration ", "[CAS_ANCHOR] " + "x" * 240, "3. 성분 4 [CAS_ANCHOR]", "[CAS_ANCHOR] concentration of what is there in all "]
    tails = ["", " note", " ppm", " page", " : x", "%:", " category"]
    rows = [(lead + m + tail, m, len(lead) + 1, head, fall) for lead in leads for m in amounts for tail in tails for head in (True, False) for fall in (None, 3, 40)]
    df = spark.createDataFrame(rows, "row string, m string, at int, head boolean, fall int").coalesce(1)
    got = [r[0] for r in df.select(match_score(*(F.col(c) for c in df.columns))).collect()]
    assert got == [recovery.score(row, m, at - 1, head, fall) for row, m, at, head, fall in rows]


def test_html_rows(spark):
    html = "<table><TR><td rowspan=2>Name</td><td>64-17-5</td><td>50%</td></TR><tr><td>67-64-1</td></tr></table>"
    got = spark.createDataFrame([(html,)], "h string").select(html_rows("h").alias("r")).first().r
    assert got == [["Name", "64-17-5", "50%"], ["67-64-1"]]


def test_logical_rows_hold_what_comes_first():
    rows = lambda *lines: logical_rows([(y, i, text, anchor) for i, (y, text, anchor) in enumerate(lines, 1)])
    assert rows((10, "a", False), (20, "64-17-5", True), (30, "b", False), (200, "c", False)) == [2, 2, 2, -1]
    assert rows((10, "3.50%", False), (12, "wt 3.50%", False), (15, "12.50", False), (20, "x", True)) == [-1, 4, -1, 4]
    assert rows((10, "x", True), (20, "Ingredient name y", False), (30, "z", False), (40, "w", True)) == [1, 4, 4, 4]
    assert rows((10, "x", True), (80, "b", False), (150, "c", False), (240, "d", False)) == [1, 1, 1, -1]


def test_exit_veto_reads_from_below(spark):
    """Numbers on a heading's place or below it veto; a missing id stands last, as in SQL; no frame reaches to the end of a page."""
    from types import SimpleNamespace

    head, number = "4. first aid", "64-17-5"
    rows = [(1, 10, 1, head), (1, 10, 2, number), (1, 20, 3, head), (2, 10, 5, number), (2, 10, None, head), (3, 10, 1, number), (3, 20, 2, "x"), (3, 30, 3, head), (3, 5, 9, head), (None, 1, 1, head), (None, 2, 2, number), (4, None, 1, None)]
    words = spark.createDataFrame([(d, 1, y, i, x) for d, y, i, x in rows], "doc_id long, page int, y0 long, id long, text string")
    out = extraction.exit_veto(SimpleNamespace(word=words))
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r.doc_id, r.id): r.leaves for r in out.collect()} == {(1, 1): False, (1, 3): True, (2, None): True, (3, 3): True, (3, 9): False, (None, 1): False}
