"""Queries that SQL can express give the rows of their statements on the smallest tables."""

import os

import duckdb
import pytest

from inklattice.llm import queries

SF = "/root/testdata/sf0.001"


def shown(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.7g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    mine = sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in got.collect())
    theirs = sorted(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert mine == theirs


def test_every_query_has_a_place():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and sum(n.startswith("op") for n in queries.QUERIES) == 10
