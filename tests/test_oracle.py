"""The iterated SQL of the methods against the queries and against the definitions, on a graph where the methods differ."""

import duckdb
import pytest

from tests.test_methods import refined
from weft import queries
from weft.plans.languages import METHODS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    return lambda text: set(con.execute(text).fetchall())


@pytest.fixture(scope="module")
def woven(spark):
    return {tuple(r) for r in queries.woven_graph(spark, SF).collect()}


@pytest.mark.parametrize("method", ["default", "all"])
def test_query_is_the_sql(spark, sql, method):
    got = {tuple(r) for r in queries.queries()[f"woven_{method}"](spark, SF).select("src", "dst").collect()}
    assert got == sql(queries.oracle_sql()[f"woven_{method}"])


@pytest.mark.parametrize("method", METHODS)
def test_sql_is_the_definition(sql, woven, method):
    assert refined(woven, method) == sql(queries.oracle_sql()[f"woven_{method}"])


def test_methods_differ(sql):
    sets = [sql(queries.oracle_sql()[f"woven_{n}"]) for n in ("under", "parity2", "parity", "default")]
    assert sets[0] < sets[1] <= sets[2] < sets[3]


def test_too_few_rounds_fail(sql):
    ctes, result = queries.oracle.over("woven", "all", 1, 2)
    with pytest.raises(duckdb.Error, match="more rounds"):
        sql(f"WITH RECURSIVE {queries._WOVEN},{ctes} {result}")


@pytest.mark.parametrize("name", ["woven_valueflow_under", "woven_valueflow"])
def test_value_flow_is_the_sql(spark, sql, name):
    got = {tuple(r) for r in queries.queries()[name](spark, SF).select("src", "dst").collect()}
    assert got == sql(queries.oracle_sql()[name]) and got
