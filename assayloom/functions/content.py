"""Concentration texts: one ordered decision list, evaluated inside the engine.

The list is a series of steps, each an SQL expression over the columns before it. A dialect spells the few functions on which
engines differ, so the same list runs as Spark projections and can be handed to another SQL engine for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "미기재%"
REMAINDER = "Rem.%"
#: The largest percentage that a sheet may state, with room for rounding.
LIMIT = 110
#: Words for a remainder.
REMAINDER_WORDS = r"(rem\b|rem\.|balance|remainder|residual|\brest\b|잔량|나머지)"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


class Spark:
    @staticmethod
    def lit(text: str) -> str:
        return f"r'{text}'"

    def sub(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to.replace(chr(92), '$'))})"

    def has(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {self.lit(pattern)})"

    def get(self, s: str, pattern: str, group: int) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, 0)"

    def each(self, s: str, pattern: str, to) -> str:
        """s with every match m of pattern replaced by to(m)."""
        return f"array_join(zip_with(split({s}, {self.lit(pattern)}, -1), transform({self.all(s, pattern)}, m -> {to('m')}), (g, m) -> concat(g, coalesce(m, ''))), '')"

    @staticmethod
    def size(a: str) -> str:
        return f"size({a})"

    @staticmethod
    def at(a: str, i: int) -> str:
        return f"get({a}, {i - 1})"


class DuckDB(Spark):
    @staticmethod
    def lit(text: str) -> str:
        return f"'{text}'"

    def each(self, s: str, pattern: str, to) -> str:
        matches = f"list_transform({self.all(s, pattern)}, lambda m: {to('m')})"
        return f"array_to_string(list_transform(list_zip(regexp_split_to_array({s}, {self.lit(pattern)}), {matches}), lambda z: concat(z[1], coalesce(z[2], ''))), '')"

    def sub(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to)}, 'g')"

    def has(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    @staticmethod
    def size(a: str) -> str:
        return f"len({a})"

    @staticmethod
    def at(a: str, i: int) -> str:
        return f"({a})[{i}]"


def steps(source: str, d: Spark) -> list[tuple[str, str]]:
    """(column, expression) in order; the last is the normal form of source."""
    number = lambda s: f"TRY_CAST({s} AS DECIMAL(20, 6))"
    show = lambda n: d.sub(d.sub(f"CAST({n} AS STRING)", r"0+$", ""), r"\.$", "")
    percent = lambda *parts: f"concat({', '.join(parts)}, '%')"
    bounds = rf"(?:>=|≥|≧)\s*({NUMBER})\s*%?\s*(?:-|~|to)?\s*(?:<=|≤|≦|<)\s*({NUMBER})"
    single = rf"^\s*(<=|>=|≤|≥|<|>)?\s*({NUMBER})\s*%?\s*(이하|이상|이내|\+)?\s*%?\s*$"
    return [
        ("_in", f"trim(translate(coalesce({source}, ''), '％～∼＜＞．＋０１２３４５６７８９', '%~~<>.+0123456789'))"),
        ("_dot", d.sub(d.sub("_in", r"([0-9]),([0-9]+\s*[-~]\s*[0-9]+[.,][0-9]+\s*%)", r"\1.\2"), r"([0-9]),([0-9]+\s*%)", r"\1.\2")),
        ("_text", d.sub(d.sub("_dot", r"[0-9]{2,7}-[0-9]{2}-[0-9]\b", " "), r"[0-9]{3}-[0-9]{3}-[0-9]", " ")),
        ("_low", "lower(_text)"),
        ("_plain", d.sub(d.sub("_low", r"20[0-2][0-9][-./][0-9]{1,2}(?:[-./][0-9]{1,2})?", " "), r"\s+", "")),
        ("_texts", d.all("_plain", NUMBER)),
        ("_n", d.size("_texts")),
        ("_a", number(d.at("_texts", 1))),
        ("_b", number(d.at("_texts", 2))),
        ("_lo", "least(_a, _b)"),
        ("_hi", "greatest(_a, _b)"),
        ("_range", d.has("_low", r"[-~]|to") + " AND _n >= 2"),
        ("_tail", d.get("_plain", r"(<|>)%?$", 1)),
        ("_one", d.get("_low", single, 2)),
        ("_kept", d.all(d.sub("_dot", r"\s", ""), NUMBER)),
        ("_ge", f"{d.has('_plain', r'≥|>=|이상|min|[+]')}"),
        ("_le", f"{d.has('_plain', r'≤|<=|이하|이내|max')}"),
        ("_more", f"(_tail = '<' OR (_tail = '' AND {d.has('_plain', r'>|초과|more|over')}))"),
        ("_less", f"(_tail = '>' OR (_tail = '' AND {d.has('_plain', r'<|미만|below|less')}))"),
        ("_sign", "CASE WHEN _ge THEN '≥' WHEN _more THEN '>' WHEN _le THEN '≤' WHEN _less THEN '<' ELSE '' END"),
        ("_plus", d.size(d.all("_plain", r"[+]|이상"))),
        ("_signs", d.size(d.all("_plain", r"[<>≤≥]"))),
        ("_upper", f"CASE WHEN _hi = 1 AND {d.has('_plain', r'<|≤|미만|이하')} THEN '<' WHEN {d.has('_plain', r'[-~](?:>=|≥)')} THEN '≥' WHEN {d.has('_plain', r'[-~]>')} THEN '>' ELSE '' END"),
        ("_out", f"""CASE
            WHEN _dot <> _in AND {d.has('_dot', r'%')} AND {d.size('_kept')} >= 2 THEN {percent(d.at('_kept', 1), "'~'", d.at('_kept', 2))}
            WHEN _dot <> _in AND {d.has('_dot', r'%')} THEN {percent('_sign', d.at('_kept', 1))}
            WHEN {d.has('_low', bounds)} THEN {percent(show(number(d.get('_low', bounds, 1))), "'~'", show(number(d.get('_low', bounds, 2))))}
            WHEN {d.has('_plain', r'^$|^미기재%?$')} THEN '{MISSING}'
            WHEN NOT (_range) AND _one <> '' AND _a > {LIMIT} THEN '{MISSING}'
            WHEN NOT (_range) AND _one <> '' THEN {percent('_sign', show('_a'))}
            WHEN {d.has('_low', r'h[0-9]{3}|구분|category|급성|독성|acute|toxic|hazard')} AND NOT ({d.has('_low', '%')} AND {d.has('_low', r'[-~]')}) THEN '{MISSING}'
            WHEN {d.has('_low', REMAINDER_WORDS)} THEN '{REMAINDER}'
            WHEN {d.has('_low', r'[0-9]\s*[a-z]+')} AND NOT {d.has('_low', r'%|below|less|more|over|[0-9]\s*to\s*[0-9]')} THEN '{MISSING}'
            WHEN {d.has('_plain', r'±')} AND _n >= 2 THEN {percent(show('(_a - _b)'), "'~'", show('(_a + _b)'))}
            WHEN _n = 0 THEN '{MISSING}'
            WHEN _n = 1 AND _a > {LIMIT} THEN '{MISSING}'
            WHEN _n = 1 AND {d.has('_plain', r'[≥>].*[-~]|[-~].*[≥>]')} AND _tail = '' THEN {percent("'≥'", show('_a'))}
            WHEN _n = 1 THEN {percent('_sign', show('_a'))}
            WHEN _n = 2 AND NOT {d.has('_plain', r'[-~]|to')} AND _signs = 1 THEN {percent('_sign', show('_b'))}
            WHEN _plus >= 2 THEN {percent("'≥'", show('_lo'))}
            WHEN _hi > {LIMIT} OR _lo = _hi THEN '{MISSING}'
            ELSE {percent(show('_lo'), "'~'", '_upper', show('_hi'))} END"""),
    ]


def plain_form(text: Column) -> Column:
    """The normal form of the common shapes (nothing, a whole number with or without a sign, a rising range of whole numbers); null for others."""
    one, two = r"^\s*([<>≤≥]?)\s*([0-9]{1,3})\s*%?\s*$", r"^\s*([0-9]{1,3})\s*[-~]\s*([0-9]{1,3})\s*%?\s*$"
    number = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    return (
        F.when(text.isNull() | (text == "") | (text == MISSING), MISSING)
        .when(text.rlike(one) & (number(one, 2) <= LIMIT), F.concat(F.regexp_extract(text, one, 1), number(one, 2).cast("string"), F.lit("%")))
        .when((number(two, 1) < number(two, 2)) & (number(two, 2) <= LIMIT), F.concat(number(two, 1).cast("string"), F.lit("~"), number(two, 2).cast("string"), F.lit("%")))
    )


def normalise(df: DataFrame, source: str, out: str = "content_norm") -> DataFrame:
    """df with the normal form of column source as out. The common shapes are told first; the steps then see an empty text in their place."""
    before = df.columns
    df = df.withColumn("_plain_form", plain_form(F.col(source))).withColumn("_odd", F.when(F.col("_plain_form").isNull(), F.col(source)).otherwise(""))
    for name, expression in steps("_odd", Spark()):
        df = df.withColumn(name, F.expr(expression))
    return df.select(*before, F.coalesce("_plain_form", "_out").alias(out))


def normalise_distinct(df: DataFrame, source: str, out: str = "content_norm") -> DataFrame:
    """The same, each different text once: sheets repeat a few texts, which are few enough for Spark to broadcast, or else are shuffled.

    df is read twice, so it should be no more than a scan.
    """
    keyed = df.withColumn("_source", F.coalesce(source, F.lit("")))
    forms = normalise(keyed.select("_source").distinct(), "_source", out)
    return keyed.join(forms, "_source").select(*df.columns, out)


def normalise_sql(source_sql: str, source: str, out: str = "content_norm") -> str:
    """A subquery with the same column for another engine."""
    inner = f"({source_sql})"
    for name, expression in steps(source, DuckDB()):
        inner = f"(SELECT *, {expression} AS {name} FROM {inner})"
    return f"SELECT * EXCLUDE ({', '.join(n for n, _ in steps(source, DuckDB()))}), _out AS {out} FROM {inner}"


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"[0-9]{2,7}-[0-9]{2}-[0-9]\b", ""), F.lit(NUMBER), 0), lambda x: x.cast("decimal(20,6)"))


def measured_value(text: Column) -> Column:
    """The 1 % rule: the largest number; 0.5 for "below 1" and less; 100 where there is none."""
    most = F.array_max(numbers(text))
    return F.when(most.isNull(), F.lit(100).cast("decimal(20,6)")).when(F.contains(text, F.lit("<")) & (most <= 1), F.lit(0.5).cast("decimal(20,6)")).otherwise(most)


def legacy_min_max(text: Column) -> Column:
    """(lo, hi) as texts, as the older reader gives them: a sign before the first number decides; nothing stated is 100."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    pair = F.regexp_extract(bare, rf"({NUMBER})%?[~-]({NUMBER})", 1)
    upper = F.regexp_extract(bare, rf"({NUMBER})%?[~-]({NUMBER})", 2)
    below = F.regexp_extract(bare, rf"[<≤]({NUMBER})", 1)
    above = F.regexp_extract(bare, rf"[>≥]({NUMBER})", 1)
    one = F.regexp_extract(bare, NUMBER, 0)
    make = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    return (
        F.when((bare == "") | F.contains(bare, F.lit("미기재")), make(F.lit("100"), F.lit("100"))).when(pair != "", make(pair, upper))
        .when(below != "", make(F.lit("0"), below)).when(above != "", make(above, F.lit("100"))).when(one != "", make(one, one))
        .otherwise(make(F.lit("100"), F.lit("100")))
    )
