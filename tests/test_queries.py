"""Every registered query against its SQL, on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TIDEMARK_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    assert oracle.compare(spark, db, name, FOLDER) is None


def test_flagship(spark):
    assert 0 < len(entry.entry(spark).collect()) <= 15


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
