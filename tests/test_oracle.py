"""Every registered query against its SQL in another engine, and all others for rows that come again."""

import pytest
from oracle import connect, rows

from campovia.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: Queries whose rows are drawn at random.
DRAWN = {"s03_sample"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_same_rows_again(spark, name):
    """Rows there are, none with all columns null, and the same ones when asked again; what they must be is in test_plain.py and test_operators.py."""
    first, again = QUERIES[name](spark, FOLDER), QUERIES[name](spark, FOLDER)
    mine = first.toPandas()
    assert len(mine) and not mine.isna().all(axis=1).any() and first.schema == again.schema
    assert name in DRAWN or rows(mine) == rows(again.toPandas())


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
