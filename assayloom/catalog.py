"""The registry of queries: each has a name, a function of (spark, sf_dir), and, where SQL can express it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources import carriers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The carriers (and raw tables) of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return carriers.load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of Tables. sql may use the carriers as tables."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = carriers.with_carriers(sql)
        return f

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from .operators import aggregates, dataset, joins, predicates, runlog, scalars, validator, windows  # noqa: F401
    from .plans import cleaning, extraction, validation  # noqa: F401
    from .sources import readers  # noqa: F401
    from .streaming import journal  # noqa: F401
