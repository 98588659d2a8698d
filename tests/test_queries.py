"""Every query against its SQL, on the smallest tables, with a session time zone that is not UTC."""

import os

import pytest

from barloom import catalog
from tests.helpers import oracle, rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    spark.catalog.clearCache()
    assert rows(got) == rows(oracle(SF, SQL[name]))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_rest_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "barloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "barloom.llm" not in p.read_text(), p
