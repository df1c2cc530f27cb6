"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


OWN = sorted(name[2:] for name in vars(entry) if name.startswith("q_"))


def test_every_query_has_sql():
    assert OWN and set(OWN) <= set(entry.oracle_sql()) & set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_sql(spark, con, name):
    complaints, rows = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name])
    assert not complaints
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "part", "score", "body"]
    assert df.select("conv_id").distinct().count() == 10
