"""Every registered query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pandas as pd
import pytest

from stridewell.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(value):
    """A cell as plain Python: None for what is missing, numbers as they are."""
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    """Rows in the order of their exact cells, then of their rounded ones."""
    found = [tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]
    exact = lambda r: tuple((x is None, str(x)) for x in r if not isinstance(x, (float, decimal.Decimal)))
    near = lambda r: tuple(float(x) for x in r if isinstance(x, (float, decimal.Decimal)))
    return sorted(found, key=lambda r: (exact(r), near(r)))


def same(a, b):
    if isinstance(a, (float, decimal.Decimal)) or isinstance(b, (float, decimal.Decimal)):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]
    assert not different, different[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    catalog.QUERIES[name](spark, DIR).collect()
