"""Every registered query against its SQL, whole tables, at the smallest scale."""

import re

import pytest

import __spark_entry__ as contract
from oracle_check import compare, duck

from conftest import SF

# The training-data queries are an optional part with tests of their own.
OWN = re.compile(r"(?!op\d+_|pipeline$)")
QUERIES = {name: query for name, query in contract.queries().items() if OWN.match(name)}
SQL = {name: sql for name, sql in contract.oracle_sql().items() if OWN.match(name)}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    same, n, _, note = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert same, note
    assert n > 0


def test_flags_are_not_vacuous(spark):
    for name in ("injection_flags", "jailbreak_flags", "has_pii", "strict_parse", "allowlist", "token_limit"):
        values = {r[1] for r in QUERIES[name](spark, SF).collect()}
        assert values == {True, False}, name


def test_entry(spark):
    df = contract.entry(spark)
    assert "minute" in df.columns and df.count() > 0
