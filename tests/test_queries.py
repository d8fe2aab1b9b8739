"""Every registered query of the library's own operators against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from spectrion.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, DIR)
    expected = db.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
