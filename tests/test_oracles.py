"""Every program-fact query against its SQL on the smallest tables."""

import pytest

from ferrule.plans import catalogue

from .compare import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert spark_rows(got) == sql_rows(con, catalogue.ORACLES[name])
    else:
        assert got.count() >= 0


def test_entry_needs_no_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
