"""Every query of the core against its SQL, on the smallest tables, where they are at hand."""

import os

import pytest

from allelora.plans import oracle, registry
from compare import duck, rows_of

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return duck(DATA)


@pytest.mark.parametrize("name", list(registry()))
def test_query(spark, con, name):
    df = registry()[name](spark, DATA)
    ours = rows_of(df.columns, df.collect())
    if name in oracle():
        cur = con.execute(oracle()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(columns, cur.fetchall()) == ours


def test_names_and_sql():
    assert set(oracle()) <= set(registry())
