"""Every engine query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from streamlens import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if v is None else round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = db.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[k] for k in at) for r in found.fetchall())


def test_registry():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)
