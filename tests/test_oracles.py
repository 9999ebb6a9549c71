"""Every registered query with oracle SQL against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import pytest

import oracle
from sextant.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in catalog.oracle_sql():
        assert oracle.differences(df, con, catalog.oracle_sql()[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
