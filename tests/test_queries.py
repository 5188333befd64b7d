"""Every query with SQL gives the rows that DuckDB gives for it."""

import datetime
import math

import duckdb
import pytest

from corpusmill.plans import audit_queries, canonical_queries, contract_queries, document_queries, evaluation_queries, graph_queries, more_queries, overlap_queries, record_queries, registry, search_queries, table_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    found = duck.sql(registry.ORACLE[name])
    assert cols == sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    assert ordered(mine) == ordered([tuple(norm(r[i]) for i in at) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
