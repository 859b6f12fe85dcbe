"""Every registered query against its SQL on the smallest tables, the way a reader would compare them."""

import datetime as dt
import decimal
import math

import pytest

duckdb = pytest.importorskip("duckdb")

from workload.oracle import SQL  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Results of fitted models, which no SQL on the tables can express.
WITHOUT_SQL = {"lead_model_metrics", "lead_model_weights"}


@pytest.fixture(scope="module")
def engine():
    from ledgerloom.sources.trade_tables import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    if isinstance(value, (dt.datetime, decimal.Decimal)):
        return str(value)
    return str(value)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, engine, name):
    ours = QUERIES[name](spark, SF)
    names = sorted(ours.columns)
    got = sorted([tuple(plain(r[c]) for c in names) for r in ours.collect()], key=str)
    cursor = engine.execute(SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    place = [theirs.index(c) for c in names]
    assert got == sorted([tuple(plain(r[i]) for i in place) for r in cursor.fetchall()], key=str)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
