"""Every registered query against its SQL, at the smallest size."""

import pytest

import __spark_entry__ as entry
from driftline.plans import catalogue
from tests.compare import duck, same_rows


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, con, name):
    same_rows(catalogue.QUERIES[name](spark, sf), con, catalogue.SQL[name])


#: Beyond SQL: iterated means, and stems, which DuckDB has not; tests/test_operators.py compares them with Python.
WITHOUT_SQL = {"ivf_kmeans", "fts_stemmed"}


def test_every_other_query_of_the_catalogue_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
