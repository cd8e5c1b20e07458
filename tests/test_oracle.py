"""Every registered query of the library proper against its SQL on the small tables."""

import datetime

import pytest

from medlake import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(n) for n in names]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
