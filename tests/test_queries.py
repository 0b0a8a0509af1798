"""Every registered bookkeeping query against its DuckDB SQL, or, without SQL, for a stable result."""

from __future__ import annotations

import duckdb
import pytest

from tallyforge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in found.select(*columns).collect())
    if name in catalog.ORACLES:
        answer = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in answer.fetchall())
    else:
        assert rows
