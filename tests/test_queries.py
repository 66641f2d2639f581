"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest

from inklattice.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.7g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted(tuple(shown(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in cur.fetchall())
    assert mine == theirs


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
