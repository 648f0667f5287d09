"""The older rules for amounts in texts, as ordered steps that both dialects of content.py can evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .content import LIMIT, MISSING, NUMBER, DuckDB, Spark

#: Misread forms of the words for below, at most and at least.
MISREAD = ((r"미\s*[만맊밖먄내발방안]|밎안|미밖", "미만"), (r"이\s*[하핚내]", "이하"), (r"이\s*[상ㅇ]", "이상"))


def _show(d: Spark, n: str) -> str:
    """A number without trailing zeros."""
    return d.sub(d.sub(f"CAST(CAST({n} AS DECIMAL(20, 10)) AS STRING)", r"0+$", ""), r"\.$", "")


def clean_steps(source: str, d: Spark) -> list[tuple[str, str]]:
    """Misread words, spaces, ranges in comparisons, hyphens as ranges, ranges the wrong way round, a range in words."""
    text = source
    for pattern, word in MISREAD:
        text = d.sub(text, pattern, word)
    turned = rf"({NUMBER})\s*[-~∼～–—]\s*({NUMBER})\s*(%?)"
    first = lambda m: d.get(m, rf"^({NUMBER})", 1)
    second = lambda m: d.get(m, rf"[-~∼～–—]\s*({NUMBER})", 1)
    number = lambda s: f"CAST({s} AS DECIMAL(20, 10))"
    return [
        ("_c1", d.sub(text, r"\s+", " ")),
        ("_c2", d.sub(d.sub("_c1", rf">=\s*({NUMBER})\s*-\s*<\s*({NUMBER})\s*%?", r"\1~<\2%"), rf">=\s*({NUMBER})\s*-\s*<=\s*({NUMBER})\s*%?", r"\1~\2%")),
        ("_c3", d.sub("_c2", rf"({NUMBER})\s*-\s*({NUMBER})\s*%?", r"\1~\2%")),
        ("_c4", d.each("_c3", turned, lambda m: f"CASE WHEN {number(first(m))} > {number(second(m))} THEN concat({second(m)}, '~', {first(m)}, CASE WHEN {d.has(m, '%$')} THEN '%' ELSE '' END) ELSE {m} END")),
        ("_clean", f"trim({d.sub('_c4', rf'({NUMBER})\s*이상\s*~\s*({NUMBER})\s*%?\s*미만', r'\1~<\2%')})"),
    ]


def percentage_steps(source: str, d: Spark) -> list[tuple[str, str]]:
    """The formatter of one amount or range; texts with a decimal comma keep their digits as written."""
    number = lambda i: f"CAST({d.at('_nums', i)} AS DECIMAL(20, 10))"
    shown = lambda i: f"CASE WHEN _comma THEN {d.at('_nums', i)} ELSE {_show(d, d.at('_nums', i))} END"
    upper = f"CASE WHEN {d.has('_raw_low', '<|미만|below|less')} THEN '<' WHEN {d.has('_raw_low', '≤|=<|이하|이내|upto')} THEN '≤' ELSE '' END"
    one = f"CASE WHEN {d.has('_raw_low', '<|미만|below')} THEN '<' WHEN {d.has('_raw_low', '≤|=<|이하|이내|upto')} THEN '≤' WHEN {d.has('_raw_low', '>|초과|over')} THEN '>' WHEN {d.has('_raw_low', '≥|=>|이상|above')} THEN '≥' ELSE '' END"
    dotted = d.each(source, r"[0-9]+(?:[.,][0-9]+)?(?:\s*[-~]\s*[<>≤≥]?\s*[0-9]+(?:[.,][0-9]+)?)?\s*%", lambda m: f"replace({m}, ',', '.')")
    return [
        ("_comma", f"{d.has(source, '[0-9]+,[0-9]+')} AND {d.has(source, '%')}"),
        ("_dotted", dotted),
        *clean_steps("_dotted", d),
        ("_raw_low", "lower(_clean)"),
        ("_nums", d.all("_clean", NUMBER)),
        ("_shown", f"""CASE WHEN {source} = '' THEN '{MISSING}' WHEN _clean IN ('Rem.', '미기재') THEN _clean
            WHEN {d.size('_nums')} = 0 THEN CASE WHEN {d.has('_clean', '%')} THEN _clean ELSE concat(_clean, '%') END
            WHEN {d.size('_nums')} >= 2 AND {number(1)} > {number(2)} THEN concat({shown(2)}, '~', {upper}, {shown(1)}, '%')
            WHEN {d.size('_nums')} >= 2 THEN concat({shown(1)}, '~', {upper}, {shown(2)}, '%')
            ELSE concat({one}, {shown(1)}, '%') END"""),
    ]


def single_steps(source: str, d: Spark) -> list[tuple[str, str]]:
    """A single percentage with its sign before it; what holds a range sign, or no percentage, goes through."""
    pattern = r"([><=≧≦≤≥])?\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*(이상|미만|이하|초과)?"
    return [
        ("_mark", d.get(source, pattern, 1)), ("_value", d.get(source, pattern, 2)), ("_word", d.get(source, pattern, 3)),
        ("_single", f"""CASE WHEN {d.has(source, '[-~∼～]|to')} OR _value = '' THEN {source} WHEN CAST(_value AS DECIMAL(20, 10)) > {LIMIT} THEN '{MISSING}'
            ELSE concat(CASE WHEN _word = '이상' OR _mark IN ('≥', '≧') THEN '≥' WHEN _word = '이하' OR _mark IN ('≤', '≦') THEN '≤' WHEN _word = '미만' OR _mark = '<' THEN '<'
                WHEN _word = '초과' OR _mark = '>' THEN '>' ELSE _mark END, {_show(d, '_value')}, '%') END"""),
    ]


def apply(df: DataFrame, steps: list[tuple[str, str]], out: str) -> DataFrame:
    """df with the last step as out."""
    before = df.columns
    for name, expression in steps:
        df = df.withColumn(name, F.expr(expression))
    return df.select(*before, F.col(steps[-1][0]).alias(out))


def apply_sql(source_sql: str, steps: list[tuple[str, str]], out: str) -> str:
    inner = f"({source_sql})"
    for name, expression in steps:
        inner = f"(SELECT *, {expression} AS {name} FROM {inner})"
    return f"SELECT * EXCLUDE ({', '.join(n for n, _ in steps)}), {steps[-1][0]} AS {out} FROM {inner}"


__all__ = ["DuckDB", "Spark", "apply", "apply_sql", "clean_steps", "percentage_steps", "single_steps"]
