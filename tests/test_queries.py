"""Every registered query of the reference operators against its SQL in DuckDB, on the smallest tables."""

import collections
import math
from pathlib import Path

import duckdb
import pytest

from groupwise.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return round(float(v), 5)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    mine = collections.Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    theirs = collections.Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_without_sql_run(spark, sf_dir, name):
    if name in ("ridge_effects", "ridge_penalties"):
        sf_dir = str(Path(sf_dir).parent / "sf0.01")
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).collect()) == 9
