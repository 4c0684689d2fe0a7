"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from pastframe import queries as q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.4f}".replace("-0.0000", "0.0000")
    return str(x)


def canon(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return [cols[i].lower() for i in at], sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    df = q.queries()[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    got = duck.execute(q.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert canon(df.columns, rows) == canon(names, got.fetchall())
