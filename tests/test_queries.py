"""Every query against its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__
from barleycorn.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, tables, duck, name):
    got = registry.QUERIES[name](spark, tables)
    rel = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    columns = sorted(got.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_give_rows(spark, tables, name):
    rows = registry.QUERIES[name](spark, tables).collect()
    assert rows or name in ("contamination", "contamination_mixture")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
