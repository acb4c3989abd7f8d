"""Each query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A share of all queries keeps the run short; the driver compares every one.
SOME = [n for i, n in enumerate(sorted(catalog.ORACLE_SQL)) if i % 4 == 0]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "nan"):
        return "null"
    return f"{float(v):.4f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, duck, name):
    found, rel = catalog.QUERIES[name](spark, D), duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(rel.columns)
    columns = sorted(found.columns)
    place = [rel.columns.index(c) for c in columns]
    got = [tuple(map(plain, r)) for r in found.select(*columns).collect()]  # not through pandas, which makes floats of whole numbers with nulls
    assert sorted(got) == sorted(tuple(plain(r[i]) for i in place) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
