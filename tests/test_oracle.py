"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

from procurelake.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_rows_only_queries(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SMALL).limit(1).count() == 1, name


def test_compliance_takes_every_document(spark):
    got = QUERIES["compliance"](spark, SMALL).select("project_id").distinct()
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_industry_takes_every_document(spark):
    assert QUERIES["industry_docs"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
