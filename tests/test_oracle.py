"""Every registered query against its SQL, or for rows and a stable schema where there is none."""

import pytest
from conftest import DATA
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

# Model searches fit many models; they have their own tests.
SLOW = {"learner_registry", "tune", "select_features", "cv_oof"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_names_agree():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, DATA), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_gives_rows(spark, name):
    first, second = (queries()[name](spark, DATA) for _ in range(2))
    assert first.columns == second.columns
    assert first.count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 1000
    assert df.columns[0] == "row_id"
