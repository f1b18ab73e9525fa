"""Every registered query on the smallest tables, against its SQL where it has one."""

import os

import pytest

from compare import connect, difference
from segflow.plans import all_queries

FOLDER = os.environ.get("SEGFLOW_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert len(df.columns) == len(set(df.columns))
        df.collect()
