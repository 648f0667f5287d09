"""Every query gives the rows of its SQL twin."""

import math
import numbers

import numpy as np
import pandas as pd
import pytest

from assayloom import catalog

catalog.load_all()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, numbers.Real) and math.isnan(value)):
        return "null"
    if hasattr(value, "__len__") and not isinstance(value, str):
        return str(list(value))
    return str(float(value)) if isinstance(value, numbers.Number) and not isinstance(value, (bool, np.bool_)) else str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(name, spark, duck, small):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(name, spark, small):
    assert catalog.QUERIES[name](spark, small).count() > 0
