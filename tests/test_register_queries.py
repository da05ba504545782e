"""Every query of the register against its SQL, and the driver's contract."""

import pytest

from daftar.plans import core_queries, desk_queries, register_queries
from tests.oracle import same

ALL = {**register_queries.QUERIES, **desk_queries.QUERIES, **core_queries.QUERIES}
SQL = {**register_queries.ORACLE, **desk_queries.ORACLE, **core_queries.ORACLE}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, name):
    same(ALL[name](spark, small), SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    df = ALL[name](spark, small)
    assert df.columns and df.count() >= 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
