"""Queries over stored range slices: what is in one slice is not shuffled
again, and groups that span slices come out whole."""

import pytest
from pyspark.sql import functions as F

from ledgerlake import flat_hierarchy, flat_hierarchy_nested
from ledgerlake.operators.ordinal import bucket_values
from ledgerlake.schema import COLUMNS, DIMS
from tests.test_invariants import _hot_ledger
from tests.test_plans import plan


@pytest.fixture(scope="module")
def hot(spark):
    return _hot_ledger(spark, 6000).cache()


@pytest.mark.parametrize("n", [1, 8, 50])
def test_every_slice_has_its_own_bucket(spark, n):
    values = bucket_values(spark, n)
    rows = spark.createDataFrame([(v,) for v in values], "v int").select(F.expr(f"pmod(hash(v), {n})").alias("b"))
    assert [r["b"] for r in rows.collect()] == list(range(n))


def test_nested_groups_of_one_slice_are_not_shuffled_again(small_ledger):
    lines = plan(flat_hierarchy_nested(small_ledger, chunk_rows=2)).split("Union", 1)[1].split("\n")[1:]
    second = next(i for i, line in enumerate(lines) if line.lstrip().startswith("+- ") and line.index("+") == lines[0].index(":"))
    assert any("collect_list" in line for line in lines[:second])
    assert not any("Exchange hash" in line and "chunk" in line for line in lines[:second])
    assert "SortMergeJoin" not in "".join(lines)


def test_nested_group_over_many_slices(hot):
    got = flat_hierarchy_nested(hot, chunk_rows=500).collect()
    want = {tuple(r[d] for d in DIMS): r for r in flat_hierarchy(hot).collect()}
    texts: dict = {}
    for r in sorted(got, key=lambda r: r["chunk"]):
        key = tuple(r[d] for d in DIMS)
        assert all(r[c] == want[key][c] for c in ("row_count", "gross_total", "cash_dr"))
        assert [t["tx_index"] for t in r["transactions"]] == list(range(500 * r["chunk"], min(500 * r["chunk"] + 500, r["row_count"])))
        texts.setdefault(key, []).extend(tuple(t[c] for c in COLUMNS[4:]) for t in r["transactions"])
    assert max(map(len, texts.values())) > 4000
    assert texts == {k: sorted(v) for k, v in texts.items()} and {k: len(v) for k, v in texts.items()} == {k: r["row_count"] for k, r in want.items()}


@pytest.mark.parametrize("most", [100_000, 0])
def test_large_caps_join_no_group_in_one_task(spark, monkeypatch, most):
    """Three groups over 48 shuffle partitions: the thresholds are joined
    where the rows are, or to rows dealt over many tasks."""
    from ledgerlake.operators import ordinal

    monkeypatch.setattr(ordinal, "MAX_BROADCAST", most)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("v"), "id")
        kept = ordinal.among_first(df, ["g"], ["v", "id"], 2000)
        p = plan(kept)
        assert ("BroadcastHashJoin" in p and "SortMergeJoin" not in p) if most else ("_salt" in p and "SortMergeJoin" in p)
        got = {(r["g"], r["_n"], r["id"]) for r in ordinal.first_in_groups(df, ["g"], ["v", "id"], 2000).collect()}
        rows: dict = {}
        for r in df.collect():
            rows.setdefault(r["g"], []).append((r["v"], r["id"]))
        assert got == {(g, i, x[1]) for g, xs in rows.items() for i, x in enumerate(sorted(xs)[:2000])}
        assert kept.count() < 3 * 2000 * 1.6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_up_rollup_shuffles_full_groups_once(spark, small_ledger):
    """What is merged by full group is not expanded and shuffled by it again."""
    from ledgerlake.operators import rollup_state
    from ledgerlake.session import shared_dir

    path = shared_dir(spark, "one-merge")
    rollup_state.fold(small_ledger, path, 0)
    lines = plan(rollup_state.read_rollup(spark, path)).split("\n")
    assert not any("Exchange" in line and "spark_grouping_id" in line and "entity_name" in line for line in lines)


def test_hierarchy_over_many_slices(hot):
    """Groups, capped leaves and overflow rows are those of their own
    operators, and full groups are not shuffled by the rollup."""
    from ledgerlake import hierarchy, node_table
    from ledgerlake.operators.tree import leaf_nodes

    got = hierarchy(hot, max_transactions=3)
    assert not any("Exchange" in line and "spark_grouping_id" in line and "entity_name" in line for line in plan(got).split("\n"))
    groups = node_table(hot)
    kept = got.where("node_type = 'group'").select(*groups.columns)
    assert kept.exceptAll(groups).count() == 0 and groups.exceptAll(kept).count() == 0
    leaves = leaf_nodes(hot, 3)
    kept = got.where("node_type <> 'group'").select(*leaves.columns)
    assert kept.exceptAll(leaves).count() == 0 and leaves.exceptAll(kept).count() == 0


def test_global_positions_need_no_checkpoint(spark, hot):
    import os

    from ledgerlake.operators.ordinal import number_rows
    from ledgerlake.session import ensure_checkpoint_dir

    def saved():
        base = ensure_checkpoint_dir(spark).removeprefix("file:")
        return {os.path.join(d, x) for d, names, _ in os.walk(base) for x in names if x.startswith("rdd-")}

    before = saved()
    got = number_rows(hot, [], [F.col(c).asc() for c in COLUMNS], "i").collect()
    assert not saved() - before
    assert sorted(r["i"] for r in got) == list(range(6000))
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(got, key=lambda r: r["i"])] == sorted(tuple(r[c] for c in COLUMNS) for r in got)


def test_nested_tree_shuffles_columns_not_texts(spark, hot, small_ledger):
    """The parts below full groups and the groups above them are made in
    their slices; a hot leaf spans slices and parts."""
    import json

    from ledgerlake.operators.nested import nested_tree

    lines = plan(nested_tree(small_ledger, max_nodes=4)).split("\n")
    assert not any("Exchange rangepartitioning" in line and "json" in line for line in lines)
    assert any("collect_list" in line and "keys=[_slice" in line for line in lines)
    got = nested_tree(hot, max_nodes=50).collect()
    texts = [n for r in got for n in json.loads(r["json"])]

    def leaves(nodes):
        return sum(1 if n["type"] == "transaction" else leaves(n["children"]) for n in nodes)

    assert leaves(texts) == 6000 and max(r["nodes"] for r in got) <= 100
    path = "/0/2024-01-15/1/Customer/2/Retail/3/ABC Corp"
    parts = sorted((r["part"], r["json"]) for r in got if r["path"] == path)
    assert [p for p, _ in parts] == list(range(len(parts))) and len(parts) > 80
    ids = [n["id"] for _, text in parts for n in json.loads(text)]
    assert ids == [f"{path}/tx/{i}" for i in range(len(ids))]
