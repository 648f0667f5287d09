"""The main scalar functions under SQL names, as SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .cas import SHAPE

FUNCTIONS = (
    r"cas_digits(s STRING) RETURNS STRING RETURN regexp_replace(s, '[^0-9]', '')",
    rf"cas_shape(s STRING) RETURNS BOOLEAN RETURN s RLIKE r'{SHAPE}'",
    r"cas_valid(s STRING) RETURNS BOOLEAN RETURN s RLIKE r'" + SHAPE + r"' AND aggregate(sequence(2, length(regexp_replace(s, '[^0-9]', ''))), 0, "
    r"(a, i) -> a + (i - 1) * TRY_CAST(substr(reverse(regexp_replace(s, '[^0-9]', '')), i, 1) AS INT)) % 10 <=> TRY_CAST(right(s, 1) AS INT)",
    r"natural_key(s STRING) RETURNS STRING RETURN array_join(transform(regexp_extract_all(s, '([0-9]+|[^0-9]+)', 1), p -> if(p RLIKE '^[0-9]+$', lpad(p, 20, '0'), lower(p))), '')",
)


def register(spark: SparkSession) -> None:
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
