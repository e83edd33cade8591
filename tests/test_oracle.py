"""Every registered query against its DuckDB oracle on the smallest tables."""
import pytest

from scholargraph.plans import catalog
from tests.oracle_harness import compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, catalog.QUERIES[name], catalog.ORACLE[name], SF)
    assert r["ok"], r
