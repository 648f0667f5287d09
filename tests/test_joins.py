"""Joins against what their operators say, on rows of their own."""

import difflib
import random

from assayloom import catalog
from assayloom.operators import joins
from assayloom.plans.cleaning import mask_known, mask_names


def test_numbers_are_repaired_by_their_check_digit(spark):
    """Water's number is 7732-18-5. Bad ones on any row are repaired, by genuine ones only, the first of the document."""
    rows = [
        (1, 1, "7732-18-4"), (1, 2, "7732-18-5"), (1, 7, "7732-18-5"), (1, 8, "7732-18-6"), (1, 14, "7732-19-5"),
        (2, 1, "7732-18-4"), (2, 2, "7732-18-6"), (3, 7, "7732-18-5"), (3, 8, "7732-18-5"), (4, 1, "64-17-6"), (4, 2, "7732-18-5"), (4, 3, None),
    ]
    got = joins.repair_invalid(spark.createDataFrame(rows, "doc_id long, seq long, cas string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, "7732-18-4", "7732-18-5"), (1, 8, "7732-18-6", "7732-18-5"), (1, 14, "7732-19-5", "7732-18-5")]
    assert "jon17_invalid_repair" in catalog.QUERIES


def test_similar_names_are_those_of_difflib(spark):
    """Against the loop of the reference, names in order."""
    dice = random.Random(5)
    names = {"sodium hydroxide solution", "abcd", "abc", "a", "톨루엔", "톨루엔 용액", *("".join(dice.choice("abc") for _ in range(dice.randint(1, 9))) for _ in range(150))}
    asked = ["sodium hydroxide sol", "abc", "abcabc", "톨루", "", "zzzz", *("".join(dice.choice("abc") for _ in range(dice.randint(1, 9))) for _ in range(40))]
    want = {}
    for word in asked:
        found = difflib.get_close_matches(word, list(names), n=3, cutoff=0.8)
        found += [n for n in sorted(names) if n not in found and (word in n or n in word) and abs(len(n) - len(word)) <= 2]
        want |= {(word, n): i for i, n in enumerate(found, 1)}
    frame = lambda values, name: spark.createDataFrame([(v,) for v in [*values, *values, None]], f"{name} string")
    got = {(r.asked, r["name"]): r.place for r in joins.similar_names(frame(asked, "asked"), frame(names, "name")).collect()}
    assert got == want
    assert ("sodium hydroxide sol", "sodium hydroxide solution") in got
    assert "jon18_similar_names" in catalog.QUERIES


def test_items_match_by_contained_names_anywhere(spark):
    j = [(1, "9-99-9", "x Toluene (5%)"), (2, None, "ring"), (3, None, "[특별]Acetone"), (4, "1-11-1", "b"), (5, "1-11-1", "b"), (6, None, "nothing"), (7, None, "()"), (8, None, "보관 톨루엔")]
    i = [(10, "1-11-1", "toluene"), (11, "2-22-2", "a b c ring d"), (12, None, "pure acetone"), (13, "3-33-3", "lu"), (14, None, "( )"), (15, None, "톨루엔 용액")]
    items = lambda rows, key: spark.createDataFrame(rows, f"{key} long, cas string, name string")
    mapped = spark.createDataFrame([(5, 1, 10), (5, 0, 13), (5, 0, 14)], "j long, f_ord int, i long")
    got = sorted(tuple(r) for r in joins.tiers(items(j, "j"), items(i, "i"), mapped).collect())
    assert got == [(1, 10, 2), (2, 11, 2), (3, 12, 2), (4, 10, 1), (5, 13, 0), (8, 15, 2)]
    assert "jon16_whole_match" in catalog.QUERIES


def test_containment_loses_nothing(spark):
    dice = random.Random(6)
    word = lambda: "".join(dice.choice("ab ") for _ in range(dice.randint(0, 7)))
    j, i = [(k, None, word()) for k in range(80)], [(k, None, word() + "b") for k in range(60)]
    bare = lambda x: x.replace(" ", "")
    want = {}
    for k, _, a in j:
        hit = next((n for n, _, b in i if bare(a) and (bare(a) in bare(b) or bare(b) in bare(a))), None)
        want |= {k: hit} if hit is not None else {}
    items = lambda rows, key: spark.createDataFrame(rows, f"{key} long, cas string, name string")
    got = joins.tiers(items(j, "j"), items(i, "i"), spark.createDataFrame([], "j long, f_ord int, i long")).collect()
    assert {r.j: r.i for r in got} == want


def test_masking_is_the_greedy_fold(spark):
    """Every text against every name, the longest first; names within names, short ones, and texts without any."""
    names = ["a", "ab", "abc", "abcd", "abcde", "toluene", "toluene diisocyanate", "lime", "", "; "]
    texts = ["abcde/abcd; ab", "toluene diisocyanate; toluene\nlime", "", "zzz", "xabcx abcdex", "lime/lime;lime"]
    got = {r.id: r.clean for r in mask_names(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(n,) for n in names * 2], "name string")).collect()}
    assert got == {i: mask_known(t, sorted(names, key=lambda n: (-len(n), n))) for i, t in enumerate(texts)}


def test_masking_meets_names_as_equals(spark):
    """Names with the same first characters are no reason to compare a text with each; nulls go through."""
    names = [f"ring {k}" for k in range(300)] + ["철", "산화철 가루", None]
    texts = [(None, "ring 7/ring 299; rin"), (1, None), (1, "산화철 가루; 철x"), (2, "ring"), (3, "x ring 12")]
    out = mask_names(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert "contains" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    whole = sorted((n for n in names if n), key=lambda n: (-len(n), n))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, t and mask_known(t, whole)) for i, t in texts), key=str)
