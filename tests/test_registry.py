"""The entry module's contract, and every SQL-expressible query against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from citeweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark conversations events part".split()


def rows(columns, values):
    plain = lambda x: round(x, 6) if isinstance(x, float) else list(x) if isinstance(x, (list, tuple)) else x
    return sorted(repr([plain(v) for v in r]) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = con.sql(registry.ORACLE[name])
    assert sorted(want.columns) == columns
    got = rows(columns, frame.select(*columns).collect())
    assert got == rows(columns, want.select(*(f'"{c}"' for c in columns)).fetchall()) and got


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries) and len(registry.ORACLE) > 20


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns[:3] == ["qid", "label", "place"]
    assert got.filter("place = 1 and label = 'S1'").count() == got.select("qid").distinct().count() > 0
