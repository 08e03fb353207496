"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from ledgerlake.plans import oracle
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle_or_is_weak():
    from ledgerlake.plans.catalog import WEAK, queries
    from ledgerlake.plans.oracle import oracle_sql

    assert set(queries()) == set(oracle_sql()) | WEAK


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_duckdb(spark, name):
    res = compare(spark, SF, [name], verbose=False)
    assert res[name][0] is True, res[name]


def test_weak_queries_run(spark):
    from ledgerlake.plans.catalog import WEAK

    for name in WEAK:
        assert E.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 181
    assert df.columns[:4] == ["level", "entity_type", "entity_sub_type", "entity_name"]
