"""Every query with SQL against DuckDB, every other one that it runs."""

import pytest

from tests.oracle import connect, same
from tidewell import catalogue

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    assert df.columns and df.collect() is not None


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "document_key", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
