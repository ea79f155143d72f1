"""Every query with SQL against DuckDB on the same tables, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from fathomline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def comparable(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.6g}" if isinstance(value, (int, float)) or hasattr(value, "as_tuple") else str(value)


def rows(pdf):
    return sorted(tuple(map(comparable, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    mine, wanted = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(mine.columns) == sorted(wanted.columns)
    assert rows(mine) == rows(wanted)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_named_queries_are_registered():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_simulated_fits_have_the_default_draws():
    assert catalogue.TRE.draws == catalogue.GTRE.draws == catalogue.FR.Frontier.draws == 500
