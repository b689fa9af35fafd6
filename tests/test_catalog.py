import pytest

from oracle import rows_of, sql_rows
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, name):
    got, names = rows_of(catalog.QUERIES[name](spark, SF))
    want, wanted = sql_rows(SF, catalog.ORACLES[name])
    assert names == wanted
    assert got == want and got
