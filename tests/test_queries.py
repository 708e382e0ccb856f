"""Every query of the library against its SQL twin."""

import pytest
from compare import DATA, connect, rows_of, rows_of_sql

from maskwright.plans.all import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    return connect()


def test_all_but_those_with_look_around_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"detect_documents"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(db, ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
