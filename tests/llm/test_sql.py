"""Queries that SQL can express, on the given tables."""

import pytest

from oracle import rows_of, sql_rows
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    got, names = rows_of(QUERIES[name](spark, SF))
    want, wanted = sql_rows(SF, ORACLES[name])
    assert names == wanted
    assert got == want and got


def test_numbers_are_complete():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
