"""What a page index shuffles, stores and sorts: the lines once for their
joins, no copy of the ledger beside the index, one slice in a task."""

import glob
import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerlake.operators.ordinal import SLICE, SPREAD, slices, spread_key
from ledgerlake.operators.page_index import read_page_index, write_page_index
from ledgerlake.schema import COLUMNS
from ledgerlake.session import shared_dir
from ledgerlake.sources.tables import LEDGER_SQL, LEDGER_TABLES, ledger_from_tables, read_table
from tests.conftest import SF_SMALL
from tests.test_kept_ledger import fresh, same
from tests.test_plans import plan


def test_lines_are_shuffled_for_one_join_only(spark):
    """Even where customers are too many to broadcast."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        ledger = ledger_from_tables(spark, SF_SMALL)
        text = plan(ledger)
        # The plan is printed from its root: the lines join what the orders became.
        assert text.index("SortMergeJoin [l_orderkey") < text.index("SortMergeJoin [o_custkey"), text
        tables = {t: read_table(spark, SF_SMALL, t) for t in LEDGER_TABLES}
        assert same(ledger, spark.sql(LEDGER_SQL, **tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_an_indexed_page_saves_no_ledger_beside_its_index(spark):
    def saved():
        return set(glob.glob(os.path.join(shared_dir(spark, "*").removeprefix("file:"))))

    before = saved()
    E.queries()["indexed_page"](spark, SF_SMALL).collect()
    kinds = sorted(os.path.basename(d).replace("_", "-").split("-")[0] for d in saved() - before if "pages-" in d or "ledger-" in d or "slices_" in d or "ranged-" in d)
    assert kinds == ["pages", "slices", "slices"]


def test_a_task_numbers_one_slice_however_large_the_splits(spark):
    """4,000 rows, half of them equal, in 6 slices that one split would hold."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(1999)).alias("v"))
    stored = slices(rows, [], [F.col("v").asc()], partitions=6)
    numbered = stored.numbered(stored.rows, [F.col("v").asc()], "i")
    assert "Exchange hashpartitioning" not in plan(numbered)
    tasks = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 6 and max(tasks) < 1200 and sum(tasks) == 4000
    got = [(r["i"], r["v"]) for r in numbered.drop(SLICE).orderBy("i").collect()]
    assert got == list(enumerate(sorted(r["v"] for r in rows.collect())))


def test_an_index_made_from_another_has_every_row(spark, small_ledger):
    path, rows = fresh(spark, "index"), small_ledger.select(*COLUMNS)
    write_page_index(rows, f"{path}/plain", range_rows=700)
    plain = read_page_index(spark, f"{path}/plain")
    order = (("cash_dr", "desc"),)
    write_page_index(plain.rows.select(*COLUMNS), f"{path}/sorted", order, range_rows=700)
    by_cash = read_page_index(spark, f"{path}/sorted", order)
    for index in (plain, by_cash):
        assert index.total() == rows.count() and same(index.rows.select(*COLUMNS), rows)
        places = [r["row_index"] for r in index.rows.select("row_index").orderBy("row_index").collect()]
        assert places == list(range(len(places)))
        assert {r["row_count"] for r in index.ranges.where(f"start + 700 <= {len(places)}").collect()} == {700}


def test_the_spread_of_equal_rows_is_two_bytes(spark):
    keys = spark.range(200_000).select(spread_key().alias("k"))
    seen = keys.agg(F.min("k"), F.max("k"), F.countDistinct("k")).first()
    assert seen[0] >= 0 and seen[1] < SPREAD == 1 << 16 and seen[2] > 50_000
