"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from statuta.plans import registry

DIR = os.environ.get("STATUTA_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return v


def same_rows(got, want):
    order = lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    return sorted(map(lambda r: tuple(map(normal, r)), got), key=lambda r: str(order(r))), sorted(map(lambda r: tuple(map(normal, r)), want), key=lambda r: str(order(r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    want = rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    want = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want]
    a, b = same_rows(got, want)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
    assert a, "no rows: the comparison proves nothing"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
