"""Every registered query against its DuckDB oracle at sf0.01 (row count,
column names, order-insensitive values), plus the entry smoke check."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF01

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


DUCK_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


SF = os.environ.get("LOGTIDE_ORACLE_SF", SF01)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_catalogue_query_has_an_oracle():
    assert set(entry.catalog.queries()) == set(entry.catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    rel = duck.sql(entry.oracle_sql()[name])
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(scols) == sorted(ocols)
    otypes = dict(zip(ocols, [str(t) for t in rel.types]))
    assert {c: DUCK_TYPES.get(t, t) for c, t in df.dtypes} == otypes
    assert len(srows) == len(orows)
    assert _canon(srows, scols) == _canon(orows, ocols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["time_bin", "priority", "level", "count"]
    assert df.count() > 0
