"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from ledgerlark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if v is None or v != v:
        return "~"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).replace(" 00:00:00", "")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted("|".join(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    assert rows(__spark_entry__.queries()[name](spark, data).toPandas()) == rows(duck.sql(__spark_entry__.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
