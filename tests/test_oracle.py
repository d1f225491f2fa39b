"""Every query with SQL gives DuckDB's rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from almanac.plans import adapters, agenda, gates, history, indexes, landed, records, state  # noqa: F401 (the others add their queries)

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(agenda.oracle_sql()))
def test_query_gives_the_oracles_rows(spark, duck, name):
    df = agenda.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(agenda.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, want.fetchall())
