"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E
import oracle  # noqa: E402
from oracle import compare  # noqa: E402

oracle.STRICT = True  # bit-exact floats, as a strict value hash would compare

SF = os.environ.get("TIEOUT_TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "match_rate" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    res = compare(spark, name, QUERIES[name], ORACLE[name], SF)
    assert res["ok"], res


def test_every_query_has_an_oracle():
    from tieout.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
