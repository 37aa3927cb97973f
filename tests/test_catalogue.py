"""Every catalogue query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.sql(catalogue.ORACLES[name])
    at = [r.columns.index(c) for c in columns]
    assert sorted(r.columns) == columns
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
