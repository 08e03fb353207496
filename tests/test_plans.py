"""Physical plan checks: no Python stages, one Expand per rollup, filters
pushed to the Parquet scan of a saved ledger."""

import pytest

import __spark_entry__ as E
from ledgerlake.plans import catalog
from ledgerlake import apply_filter, rollup_table
from ledgerlake.session import shared_dir
from ledgerlake.sources.sinks import write_ledger

SF = "/root/testdata/sf0.001"
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "PythonUDF")


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_stage(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert not any(n in p for n in PY_NODES), p


def longest_method(df) -> int:
    """Bytes of bytecode of the longest generated method of a plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        found = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_generated_methods_are_short_enough_to_be_compiled(small_ledger):
    """The JVM interprets methods of over 8,000 bytes."""
    from ledgerlake import browse, entity_rollup, flat_hierarchy, monthly_reconciliation, node_table, totals

    for make in (node_table, rollup_table, flat_hierarchy, totals, entity_rollup, monthly_reconciliation, browse):
        assert 0 < longest_method(make(small_ledger)) < 8000, make.__name__


def test_one_expand_in_rollup(small_ledger):
    p = plan(rollup_table(small_ledger))
    assert p.count("Expand") == 1


@pytest.fixture(scope="module")
def saved(spark, small_ledger):
    path = shared_dir(spark, "plan-test-ledger")
    write_ledger(small_ledger, path, partitions=4)
    return spark.read.parquet(path)


def test_equality_filters_pushed(saved):
    p = plan(apply_filter(saved, {"date": "1998-08-23", "entity_type": "ASIA"}))
    assert "PushedFilters: [IsNotNull(txn_date), IsNotNull(entity_type), EqualTo(txn_date,1998-08-23), EqualTo(entity_type,ASIA)]" in p


def test_filter_reaches_scan_below_rollup(saved):
    p = plan(rollup_table(saved, {"entity_type": "ASIA"}))
    assert "EqualTo(entity_type,ASIA)" in p


def test_projection_pruned(saved):
    from ledgerlake import totals

    p = plan(totals(saved, {"entity_type": "ASIA"}))
    assert "ReadSchema: struct<entity_type:string,cash_dr:double,cash_cr:double,bank_dr:double,bank_cr:double>" in p


def test_saved_ledger_same_answers(spark, saved, small_ledger):
    from ledgerlake import node_table

    a = node_table(saved)
    b = node_table(small_ledger)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_small_cap_plans_map_side_group_limit(small_ledger):
    from ledgerlake import leaf_cap

    p = plan(leaf_cap(small_ledger, 3))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_month_partitioned_ledger_prunes_and_agrees(spark, small_ledger):
    from ledgerlake import date_range, totals
    from ledgerlake.sources.sinks import read_saved_ledger

    path = shared_dir(spark, "plan-test-ledger-by-month")
    write_ledger(small_ledger, path, partitions=4, by_month=True)
    led = read_saved_ledger(spark, path)
    assert dict(led.dtypes)["txn_month"] == "string" and dict(led.dtypes)["txn_date"] == "string"
    spec = {"date": "1998-08-23", "entity_type": "ASIA"}
    p = plan(apply_filter(led, spec))
    assert "PartitionFilters: [isnotnull(txn_month" in p and "(txn_month" in p and "= 1998-08)" in p
    assert totals(led, spec).first() == totals(small_ledger, spec).first()
    a = date_range(led, "1996-01-01", "1996-03-31")
    b = date_range(small_ledger, "1996-01-01", "1996-03-31")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert "PartitionFilters" in plan(a) and "txn_month" in plan(a).split("PartitionFilters")[1][:200]
