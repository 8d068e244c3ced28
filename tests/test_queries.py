"""Every query of the library against its SQL in DuckDB, and the driver's contract."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from barloom.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), SQL[name], con) == ""


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in QUERIES if n not in SQL} == {"factors_recursive", "factor_weights", "pca_components"}
