"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from keyloom.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    try:
        return str(round(float(value), 6)) if not isinstance(value, str) else value
    except (TypeError, ValueError, OverflowError):
        return str(value)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    found = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), columns)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(queries()) - set(oracle_sql()) == {"curve_matching"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_finds_rows(name):
    """A query that agrees on nothing proves nothing; the driver compares on the next larger tables."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    assert c.execute(oracle_sql()[name]).fetchone() is not None


@pytest.mark.parametrize("name", ["sql_q2", "sql_q3", "sql_q4", "sql_q5", "sql_q7", "sql_q8", "sql_q9", "sql_q10", "sql_q12", "sql_q14", "sql_q17", "sql_q18", "sql_q19", "sql_q20", "sql_q21", "join_inner", "join_natural", "join_left_outer"])
def test_equalities_are_join_keys(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["sql_q6", "sql_key_filter", "filter_range"])
def test_filters_reach_the_scan(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(" in plan.split("PushedFilters: ")[1]
