"""Goldens on the six-row ledger (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from ledgerlake import (
    browse,
    children,
    export_report,
    filter_options,
    flat_hierarchy,
    group_lookup,
    leaf_nodes,
    level_summary,
    node_table,
    profile,
    totals,
)
from ledgerlake.operators.filters import apply_filter


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_totals(six):
    t = one(totals(six))
    assert t == {"row_count": 6, "cash_dr": 15000.0, "cash_cr": 5000.0, "bank_dr": 15500.0, "bank_cr": 0.0}


def test_filter_date(six):
    assert apply_filter(six, {"date": "2024-01-15"}).count() == 2
    t = one(totals(six, {"date": "2024-01-15"}))
    assert (t["cash_dr"], t["cash_cr"]) == (15000.0, 0.0)


def test_filter_type(six):
    t = one(totals(six, {"entity_type": "Customer"}))
    assert (t["row_count"], t["cash_dr"], t["bank_dr"]) == (3, 15000.0, 15000.0)


def test_filter_two_keys_and_display_names(six):
    t = one(totals(six, {"Date": "2024-01-15", "Entity Type": "Customer"}))
    assert (t["row_count"], t["cash_dr"]) == (2, 15000.0)


def test_filter_absent_value(six):
    t = one(totals(six, {"entity_type": "Nobody"}))
    assert t == {"row_count": 0, "cash_dr": 0.0, "cash_cr": 0.0, "bank_dr": 0.0, "bank_cr": 0.0}


def test_falsy_values_do_not_filter(six):
    assert apply_filter(six, {"date": "", "entity_type": None}).count() == 6


def test_unknown_filter_key_raises(six):
    import pytest

    with pytest.raises(KeyError):
        apply_filter(six, {"colour": "red"})


def test_options(six):
    got = {}
    for r in filter_options(six).collect():
        got.setdefault(r["dimension"], []).append(r["value"])
    assert got["txn_date"] == ["2024-01-15", "2024-01-16", "2024-01-17"]
    assert got["entity_type"] == ["Bank", "Customer", "Vendor"]
    assert got["entity_sub_type"] == ["Finance", "Online", "Retail", "Service", "Wholesale"]
    assert got["entity_name"] == ["ABC Corp", "Bank of Test", "DEF Services", "GHI Inc", "XYZ Ltd"]


def test_node_table_sizes(six):
    nodes = node_table(six)
    per_level = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert per_level == {0: 3, 1: 4, 2: 5, 3: 5}
    leaves = nodes.filter("level = 3").agg(F.sum("row_count")).first()[0]
    assert leaves == 6
    root = nodes.filter("node_id = '/0/2024-01-15/1/Customer'").first()
    assert root["parent_id"] == "/0/2024-01-15" and root["label"] == "Customer" and root["column"] == "Entity Type"


def test_gross_total_of_dates(six):
    got = {r["value"]: (r["gross_total"], r["row_count"]) for r in level_summary(six, 0).collect()}
    assert got == {"2024-01-15": (15000.0, 2), "2024-01-16": (5000.0, 2), "2024-01-17": (15500.0, 2)}


def test_flat_hierarchy_order(six):
    rows = flat_hierarchy(six).orderBy("txn_date", "entity_type", "entity_sub_type", "entity_name").collect()
    assert [(r["entity_name"], r["row_count"]) for r in rows] == [
        ("ABC Corp", 2), ("DEF Services", 1), ("XYZ Ltd", 1), ("Bank of Test", 1), ("GHI Inc", 1)
    ]
    assert rows[0]["id"] == "2024-01-15/Customer/Retail/ABC Corp"


def test_browse(six):
    assert browse(six, {}).filter("level = 0").count() == 3
    got = {r["label"]: r["gross_total"] for r in browse(six, {"date": "2024-01-17"}).collect()}
    assert got == {"Bank": 500.0, "Customer": 15000.0}
    got = sorted(r["label"] for r in browse(six, {"entity_type": "Customer"}).collect())
    assert got == ["2024-01-15", "2024-01-17"]


def test_expand(six):
    got = {r["label"]: r["gross_total"] for r in children(six, ["2024-01-16", "Vendor"]).collect()}
    assert got == {"Service": 2000.0, "Wholesale": 3000.0}
    leaf = children(six, ["2024-01-15", "Customer", "Retail", "ABC Corp"], max_transactions=10).collect()
    assert sorted(r["particulars"] for r in leaf) == ["Payment received", "Second payment"]
    assert {r["node_id"] for r in leaf} == {
        "/0/2024-01-15/1/Customer/2/Retail/3/ABC Corp/tx/0",
        "/0/2024-01-15/1/Customer/2/Retail/3/ABC Corp/tx/1",
    }


def test_group_lookup(six):
    t = one(group_lookup(six, {"date": "2024-01-17", "entity_type": "Customer"}))
    assert (t["cash_dr"], t["cash_cr"], t["bank_dr"], t["bank_cr"]) == (0.0, 0.0, 15000.0, 0.0)
    assert one(group_lookup(six, {"entity_name": "Nobody"}))["row_count"] == 0
    assert one(group_lookup(six, {}))["gross_total"] == 35500.0


def test_leaf_cap_one(six):
    nodes = leaf_nodes(six, 1).collect()
    tx = [r for r in nodes if r["node_type"] == "transaction"]
    info = [r for r in nodes if r["node_type"] == "info"]
    assert len(tx) == 5
    assert len(info) == 1
    assert info[0]["label"] == "... and 1 more transactions"
    assert info[0]["parent_id"] == "/0/2024-01-15/1/Customer/2/Retail/3/ABC Corp"


def test_profile(six):
    p = one(profile(six))
    assert p["row_count"] == 6 and p["column_count"] == 10
    assert (p["start_date"], p["end_date"]) == ("2024-01-15", "2024-01-17")
    assert (p["entity_types"], p["entity_sub_types"], p["entity_names"], p["unknown_dates"]) == (3, 5, 5, 0)


def test_export(six):
    rows = export_report(six).collect()
    assert len(rows) == 7
    total = [r for r in rows if r["is_total"]]
    assert len(total) == 1
    t = total[0]
    assert t["particulars"] == "TOTAL" and t["entity_name"] == ""
    assert (t["cash_dr"], t["cash_cr"], t["bank_dr"], t["bank_cr"]) == (15000.0, 5000.0, 15500.0, 0.0)


def test_hierarchy_whole_tree(six):
    from ledgerlake.operators.tree import hierarchy

    rows = hierarchy(six).collect()
    kinds = {}
    for r in rows:
        kinds[r["node_type"]] = kinds.get(r["node_type"], 0) + 1
    assert kinds == {"group": 17, "transaction": 6}
    capped = hierarchy(six, max_transactions=1).collect()
    assert sum(r["node_type"] == "info" for r in capped) == 1
    assert sum(r["node_type"] == "transaction" for r in capped) == 5
    tx = [r for r in rows if r["node_type"] == "transaction"]
    assert all(r["is_leaf"] and not r["has_children"] for r in tx)
    parents = {r["node_id"] for r in rows if r["node_type"] == "group" and r["level"] == 3}
    assert {r["parent_id"] for r in tx} == parents


def test_reports_without_day_column(six):
    from ledgerlake.operators.reports import date_range, monthly_reconciliation

    bare = six.drop("txn_day")
    p = one(profile(bare))
    assert (p["start_date"], p["end_date"]) == ("2024-01-15", "2024-01-17")
    assert date_range(bare, "2024-01-16", "2024-01-17").count() == 4
    months = monthly_reconciliation(bare).collect()
    assert {r["month"] for r in months} == {"2024-01"}
    assert sum(r["cash_net"] for r in months) == 10000.0


def test_date_objects_in_filters(six):
    import datetime as dt

    t = one(totals(six, {"date": dt.date(2024, 1, 15)}))
    assert (t["row_count"], t["cash_dr"]) == (2, 15000.0)
    got = {r["label"] for r in children(six, [dt.date(2024, 1, 16)]).collect()}
    assert got == {"Vendor"}


def test_saved_rollup_answers_lookups(spark, six):
    import tempfile

    from ledgerlake.operators.rollup import rollup_children, rollup_lookup, write_rollup

    path = tempfile.mkdtemp(prefix="ledgerlake-rollup-") + "/r"
    write_rollup(six, path)
    r = spark.read.parquet(path)
    for keys in ({}, {"date": "2024-01-17"}, {"date": "2024-01-17", "entity_type": "Customer"},
                 {"date": "2024-01-15", "entity_type": "Customer", "entity_sub_type": "Retail", "entity_name": "ABC Corp"},
                 {"date": "1999-01-01"}):
        assert one(rollup_lookup(r, keys)) == one(group_lookup(six, keys))
    for path_ in ([], ["2024-01-16"], ["2024-01-16", "Vendor"], ["2024-01-16", "Vendor", "Service"]):
        a = sorted(tuple(x) for x in rollup_children(r, path_).collect())
        b = sorted(tuple(x) for x in children(six, path_).collect())
        assert a == b
    import pytest

    with pytest.raises(ValueError):
        rollup_lookup(r, {"entity_type": "Customer"})
