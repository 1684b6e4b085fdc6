"""The corpus queries on the smallest tables: against SQL where there is some."""

import os

import pytest

from lumenflow.llm import queries

from ..test_queries import FOLDER, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):  # noqa: F811
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    if name.startswith("op5_") and not os.path.exists(queries.VOCABULARY):
        pytest.skip("no vocabulary file")
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
