"""Every registered query of the engine against its SQL, on the smallest data."""

import pytest
from compare import connect, same

from cairn.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, small, con, name):
    same(catalogue.QUERIES[name](spark, small), catalogue.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql_has_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry_is_retrieval(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert {"question_id", "chunk_id", "position"} <= set(df.columns)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
