import pytest

from sigwright.plans import catalog

from oracle import same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, small, name):
    same_rows(catalog.QUERIES[name](spark, small), catalog.ORACLES[name], small)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["gid", "key", "count"]
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
