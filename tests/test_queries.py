"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from lumenflow.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return [plain(x) for x in v] if isinstance(v, (list, np.ndarray)) else v.item() if isinstance(v, np.generic) else v


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).to_numpy())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
