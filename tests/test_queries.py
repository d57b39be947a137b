"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from tidewater.plans import catalog, intake, integration, knowledge, ledgers, matching, passes, relational, rules, stateful, summaries, upkeep  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
