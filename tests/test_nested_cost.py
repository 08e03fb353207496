"""What a nested tree stores and sorts: the ledger's rows once, ranged by
group, whose lists are made where they lie; and the texts it puts together
without a JSON writer."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerlake import nested_tree
from ledgerlake.functions.aggregates import wide_carried, wide_names, wide_units_sql
from ledgerlake.operators.paging import sort_rows
from ledgerlake.schema import COLUMNS, DIMS
from ledgerlake.session import shared_dir
from tests.test_kept_ledger import assembled, plain_tree
from tests.test_plans import longest_method, plan


def test_full_groups_are_not_stored_again(spark, small_ledger):
    """Their slices are those of the rows: no second table is ranged by it."""

    def saved():
        return set(glob.glob(os.path.join(shared_dir(spark, "slices_*").removeprefix("file:"))))

    before = saved()
    tree = nested_tree(small_ledger, max_nodes=4)
    names = [spark.read.parquet(d).columns for d in saved() - before]
    assert sum("entity_name" in columns for columns in names) == 1
    assert not any("Exchange hash" in line and "json" in line for line in plan(tree).split("\n"))


def test_lists_are_made_by_compiled_methods(small_ledger):
    """The JVM interprets methods of over 8,000 bytes."""
    assert 0 < longest_method(nested_tree(small_ledger, max_nodes=4)) < 8000


@pytest.mark.parametrize("limit", [1, 6, 10_000])
def test_names_and_amounts_as_json_writes_them(spark, limit):
    """Names with escapes, amounts off the fast path, a group on all slices."""
    names = F.array(*[F.lit(x) for x in ("plain", 'q"uote', "back\\slash", "new\nline", "\x01", "é", "z/9")])
    amounts = F.array(*[F.lit(x) for x in (0.0, -0.25, -12.5, 99999999999.75, 2e11, -3.5e12, 1234.5)])
    some = lambda values, seed: values[F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(7)).cast("int")]
    hot = F.col("id") % 3 > 0
    df = spark.range(900).select(
        F.lit("2024-01-01").alias("txn_date"), F.when(hot, "T").otherwise(some(names, 1)).alias("entity_type"), F.when(hot, "S").otherwise(some(names, 2)).alias("entity_sub_type"),
        F.when(hot & (F.col("id") % 2 == 0), "one").otherwise(some(names, 3)).alias("entity_name"), some(names, 4).alias("vch_type"), some(names, 5).alias("particulars"),
        *[some(amounts, 6 + i).alias(m) for i, m in enumerate(COLUMNS[6:])],
    ).cache()
    got, parts = nested_tree(df, max_nodes=limit).collect(), {}
    for r in got:
        assert r["nodes"] <= 2 * limit and r["part"] not in parts.setdefault(r["path"], {})
        parts[r["path"]][r["part"]] = r["json"]
    assert assembled(parts) == plain_tree(sort_rows(df, ()).collect(), DIMS)


def test_carried_limbs_keep_their_sum(spark):
    """Sums of low limbs as large as those of 2^37 rows."""
    sums = [(2**62 - 1, -(2**37) + 5), (7, 3), (2**25, -1)]
    names = wide_names(["cash_dr"])
    rows = spark.createDataFrame([(low, high, None) for low, high in sums], f"{names[0]} bigint, {names[1]} bigint, {names[2]} decimal(38,4)")
    got = rows.select(*wide_carried(["cash_dr"])).collect()
    assert all(0 <= r[0] < 2**25 for r in got)
    assert [r[0] + r[1] * 2**25 for r in got] == [low + high * 2**25 for low, high in sums]
    units = [r["u"] for r in rows.select(*wide_carried(["cash_dr"])).select(F.expr(wide_units_sql("cash_dr")).alias("u")).collect()]
    assert units == [low + high * 2**25 for low, high in sums]
