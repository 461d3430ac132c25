"""Every query of the library against its SQL in DuckDB (sf0.001: 200 papers,
500 vectors, so vectors without papers exist)."""

import pytest

import __spark_entry__ as E
from papyra.plans import catalog
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res.startswith(("ok", "no-oracle")), res


def test_every_library_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns
