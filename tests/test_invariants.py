"""Invariants over the sf0.001 ledger view."""

import pytest
from pyspark.sql import functions as F

from ledgerlake import export_report, leaf_cap, leaf_overflow, node_table, page, rollup_table, sort_rows, totals
from ledgerlake.schema import COLUMNS, DIMS, MEASURES
from ledgerlake.sources.generator import SUB_TYPES, generate_rows


def test_levels_add_to_grand_total(small_ledger):
    r = rollup_table(small_ledger)
    grand = r.filter("level = -1").first()
    per_level = r.filter("level >= 0").groupBy("level").agg(
        F.sum("row_count").alias("n"), *[F.sum(m).alias(m) for m in MEASURES]
    ).collect()
    assert len(per_level) == 4
    for row in per_level:
        assert row["n"] == grand["row_count"]
        for m in MEASURES:
            assert abs(row[m] - grand[m]) < 1e-6


def test_children_add_to_parent(small_ledger):
    nodes = node_table(small_ledger)
    kids = (
        nodes.filter("level > 0")
        .groupBy(F.col("parent_id").alias("pid"))
        .agg(F.sum("row_count").alias("kids"), F.sum("cash_dr").alias("k_cash"))
    )
    joined = nodes.join(kids, F.col("node_id") == F.col("pid"), "inner")
    bad = joined.filter((F.col("kids") != F.col("row_count")) | (F.abs(F.col("k_cash") - F.col("cash_dr")) > 1e-6))
    assert bad.count() == 0
    assert joined.count() == nodes.filter("level < 3").count()


def test_cap_plus_overflow_is_leaf_count(small_ledger):
    levels = ["entity_type", "entity_sub_type"]
    kept = leaf_cap(small_ledger, 7, levels=levels).groupBy(*levels).count()
    more = leaf_overflow(small_ledger, 7, levels=levels).select(*levels, "remaining")
    counts = small_ledger.groupBy(*levels).agg(F.count("*").alias("n"))
    j = counts.join(kept, levels, "left").join(more, levels, "left").fillna(0, ["count", "remaining"])
    assert j.filter(F.col("count") + F.col("remaining") != F.col("n")).count() == 0
    assert j.filter(F.col("count") > 7).count() == 0


def test_pages_concatenate_to_sorted_whole(small_ledger):
    whole = [tuple(r) for r in sort_rows(small_ledger.select(*COLUMNS), ()).collect()]
    parts = []
    for off in range(0, len(whole), 1500):
        parts += [tuple(r) for r in page(small_ledger.select(*COLUMNS), (), off, 1500).collect()]
    assert parts == whole


def _walk(rows, order, limit, tie_break=tuple(COLUMNS)):
    from ledgerlake.operators.paging import next_cursor, seek_page

    got, after, seen = [], (), 0
    while chunk := seek_page(rows, after, order, limit, seen, tie_break).collect():
        got += [tuple(r) for r in chunk]
        after, seen = next_cursor(chunk, order, after, seen, tie_break)
    return got


def test_seek_pages_walk_everything(small_ledger):
    rows = small_ledger.select(*COLUMNS)
    assert _walk(rows, (), 1000) == [tuple(r) for r in sort_rows(rows, ()).collect()]


def test_seek_pages_keep_rows_that_are_equal(spark, six):
    rows = six.select(*COLUMNS)
    rows = rows.unionByName(rows).unionByName(rows.limit(1)).unionByName(rows)
    whole = [tuple(r) for r in sort_rows(rows, ()).collect()]
    for limit in (1, 2, 3, 7):
        assert _walk(rows, (), limit) == whole


def test_export_total_equals_totals(small_ledger):
    spec = {"entity_type": "ASIA"}
    t = totals(small_ledger, spec).first()
    e = export_report(small_ledger, spec).filter("is_total").first()
    for m in MEASURES:
        assert e[m] == t[m]


def test_generator(spark):
    g = generate_rows(spark, 5000, seed=7, end_date="2024-01-31")
    nonzero = sum((F.when(F.col(m) != 0, 1).otherwise(0) for m in MEASURES[1:]), F.when(F.col(MEASURES[0]) != 0, 1).otherwise(0))
    assert g.filter(nonzero != 1).count() == 0
    pairs = {(r[0], r[1]) for r in g.select("entity_type", "entity_sub_type").distinct().collect()}
    assert all(s in SUB_TYPES[t] for t, s in pairs)
    rng = g.agg(F.min("txn_day"), F.max("txn_day"), F.min(F.greatest(*MEASURES)), F.max(F.greatest(*MEASURES))).first()
    assert str(rng[0]) >= "2024-01-01" and str(rng[1]) <= "2024-01-31"
    assert rng[2] >= 100 and rng[3] <= 50000
    again = generate_rows(spark, 5000, seed=7, end_date="2024-01-31")
    assert g.exceptAll(again).count() == 0


def test_dims_never_null_after_cleaning(small_ledger):
    cond = F.lit(False)
    for c in DIMS:
        cond = cond | F.col(c).isNull()
    assert small_ledger.filter(cond).count() == 0


def test_numbered_pages_match_top_k(small_ledger):
    from ledgerlake.operators import paging

    rows = small_ledger.select(*COLUMNS)
    whole = [tuple(r) for r in sort_rows(rows, ()).collect()]
    got = []
    for off in range(0, len(whole), 2000):
        got += [tuple(r) for r in paging.numbered_page(rows, (), off, 2000).collect()]
    assert got == whole
    order = (("cash_dr", "desc"),)
    deep = [tuple(r) for r in paging.numbered_page(rows, order, 100, 50).collect()]
    assert deep == [tuple(r) for r in paging.page(rows, order, 100, 50).collect()]


def test_ordinal_with_a_hot_group(spark):
    from ledgerlake.operators.ordinal import number_rows

    # One key holds most rows; numbering must still be 0..n-1 per group.
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("g"),
        F.col("id"),
    )
    out = number_rows(df, ["g"], [F.col("id").asc()], partitions=16)
    w = __import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("g").orderBy("id")
    ref = df.withColumn("_r", F.row_number().over(w) - 1)
    bad = out.join(ref, ["g", "id"]).filter(F.col("_n") != F.col("_r"))
    assert out.count() == 20000 and bad.count() == 0


def test_large_cap_uses_bounded_numbering(small_ledger):
    from pyspark.sql.window import Window

    from ledgerlake.operators.tree import capped_rows

    levels = ["entity_type"]
    got = capped_rows(small_ledger, 1100, levels=levels)  # above the group-limit threshold
    w = Window.partitionBy(*levels).orderBy(*COLUMNS)
    ref = small_ledger.select(*COLUMNS).withColumn("_n", F.row_number().over(w) - 1).filter("_n < 1100")
    got = got.withColumn("_n", F.col("_n").cast("int"))
    assert got.count() == ref.count() == 5430
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_nested_chunks_are_whole_and_bounded(small_ledger):
    from ledgerlake.operators.rollup import flat_hierarchy_nested

    out = flat_hierarchy_nested(small_ledger, chunk_rows=2)
    sizes = out.select(F.size("transactions").alias("s"), "row_count", "chunk")
    assert sizes.filter("s > 2 OR s < 1").count() == 0
    assert sizes.agg(F.sum("s")).first()[0] == small_ledger.count()
    per_group = out.groupBy(*DIMS).agg(F.sum(F.size("transactions")).alias("s"), F.first("row_count").alias("n"))
    assert per_group.filter("s != n").count() == 0


def _hot_ledger(spark, n=30000):
    """A ledger where one (date, type, sub type, name) leaf holds 70% of rows."""
    from ledgerlake.sources.generator import generate_rows

    g = generate_rows(spark, n, seed=3, end_date="2024-01-31")
    hot = F.pmod(F.xxhash64("particulars", "cash_dr", "bank_cr"), F.lit(10)) < 7
    return g.select(
        F.when(hot, F.lit("2024-01-15")).otherwise(F.col("txn_date")).alias("txn_date"),
        F.when(hot, F.lit("Customer")).otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(hot, F.lit("Retail")).otherwise(F.col("entity_sub_type")).alias("entity_sub_type"),
        F.when(hot, F.lit("ABC Corp")).otherwise(F.col("entity_name")).alias("entity_name"),
        *[F.col(c) for c in COLUMNS[4:]],
    )


def test_hot_leaf_spreads_over_range_partitions(spark):
    led = _hot_ledger(spark)
    keys = [F.col(c).asc_nulls_first() for c in COLUMNS]
    sizes = [r["count"] for r in led.repartitionByRange(16, *keys).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 0.15 * sum(sizes)


def test_equal_rows_spread_over_range_partitions(spark):
    from ledgerlake.operators.ordinal import number_rows, range_partitioned

    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("k"))
    for n in (8, 32):
        parts = range_partitioned(df, n, [F.col("k").asc()]).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 3 * 40000 / n
    numbered = number_rows(df, ["k"], [F.col("k").asc()], "_n", partitions=8).where("k = 'same'")
    assert sorted(r["_n"] for r in numbered.collect()) == list(range(20000))


def test_hot_leaf_numbering_and_cap(spark):
    from pyspark.sql.window import Window

    from ledgerlake.operators.tree import capped_rows, transactions

    led = _hot_ledger(spark).cache()
    tx = transactions(led).select("txn_date", "entity_type", "entity_sub_type", "entity_name", "tx_index", *COLUMNS[4:])
    w = Window.partitionBy(*DIMS).orderBy(*COLUMNS)
    ref = led.withColumn("tx_index", (F.row_number().over(w) - 1).cast("bigint")).select(tx.columns)
    assert tx.count() == led.count()
    assert tx.exceptAll(ref).count() == 0
    big = capped_rows(led, 5000).groupBy(*DIMS).count().orderBy(F.desc("count")).first()
    assert big["count"] == 5000


def test_page_meta_and_unlimited_page(small_ledger):
    from ledgerlake.operators.paging import page_meta

    n = small_ledger.count()
    m = page_meta(small_ledger, 100, None).first()
    assert (m["total_count"], m["returned"], m["page_offset"]) == (n, n, 100)
    m = page_meta(small_ledger, n - 5, 50).first()
    assert m["returned"] == 5
    assert page(small_ledger, (), 123, None).count() == n  # falsy limit: all rows, offset ignored


def test_seek_descending(small_ledger):
    from ledgerlake.operators.paging import seek_page

    rows = small_ledger.select(*COLUMNS)
    order = (("cash_dr", "desc"),)
    from ledgerlake.operators.paging import total_order

    first = [tuple(r) for r in page(rows, order, 0, 300).collect()]
    keys = [k for k, _ in total_order(order)]
    after_row = first[99]
    after = tuple(after_row[COLUMNS.index(k)] for k in keys)  # the key, in sort-key order
    nxt = [tuple(r) for r in seek_page(rows, after, order, 200).collect()]
    after = after_row
    want = [r for r in first[100:] if r != after][:200]
    assert nxt[: len(want)] == want
