"""Malformed lines, the kept-up rollup, the page index, the nested tree, and
null levels in paging and nested groups."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlake import flat_hierarchy, flat_hierarchy_nested, normalize, page, rollup_table, seek_page, sort_rows
from ledgerlake.operators import rollup_state
from ledgerlake.operators.nested import nested_tree
from ledgerlake.operators.ordinal import number_rows
from ledgerlake.operators.page_index import read_page_index, write_page_index
from ledgerlake.operators.paging import next_cursor
from ledgerlake.operators.rollup import rollup_children, rollup_lookup
from ledgerlake.schema import COLUMNS, DIMS, MEASURES, RAW_SCHEMA
from ledgerlake.session import shared_dir
from ledgerlake.sources.quarantine import load_checked, read_checked
from tests.conftest import SIX_ROWS
from tests.test_plans import plan

TEN = "2024-01-15,Customer,Retail,ABC,Receipt,paid,10,0,0,0"


def fresh(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def folder(files):
    d = tempfile.mkdtemp(prefix="ledgerlake-test-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return d


def header(n):
    return ",".join(f"h{i}" for i in range(n))


def test_malformed_lines_are_kept_with_their_reason(spark):
    d = folder({
        "a.csv": "\n".join([
            header(10), TEN, "", '2024-01-16,"A, B","say ""hi""","x \\ ""y""",v,"",1,2,3,4', "a,b,c", TEN + ",11th", '2024-01-17,A,B,C,D,"never closed,1,2,3,4', "   ",
            '5" pipe,A,B,C,D,it said "yes",1,2,3,4', ",,,,,,,,,",
        ]) + "\n",
        "b.csv": "\r\n".join(['"h,0",' + header(10), TEN, TEN + ",extra", '"q,1",b,c,d,e,f,1,2,3,4,"z,z"']),
        "c.csv": header(9) + "\n" + TEN + "\n" + TEN.rsplit(",", 1)[0] + "\n",
        "d.csv": header(10) + "\n",
        "e.csv": "",
    })
    rows, rejects = read_checked(spark, d)
    got = sorted((os.path.basename(r["file"]), r["line"][:12], r["found"], r["expected"], r["reason"]) for r in rejects.collect())
    assert got == sorted([
        ("a.csv", "a,b,c", 3, 10, "too few fields"), ("a.csv", "2024-01-15,C", 11, 10, "too many fields"), ("a.csv", "2024-01-17,A", None, 10, "open quote"),
        ("b.csv", "2024-01-15,C", 10, 11, "too few fields"), ("c.csv", "2024-01-15,C", 10, 9, "header has too few columns"), ("c.csv", "2024-01-15,C", 9, 9, "header has too few columns"),
    ])
    good = {tuple(r) for r in rows.collect()}
    assert rows.count() == 6 and rows.columns == COLUMNS
    assert ("2024-01-16", "A, B", 'say "hi"', 'x \\ "y"', "v", "", "1", "2", "3", "4") in {tuple("" if x is None else x for x in r) for r in good}
    assert ('5" pipe', "A", "B", "C", "D", 'it said "yes"', "1", "2", "3", "4") in good
    assert ("q,1", "b", "c", "d", "e", "f", "1", "2", "3", "4") in good
    out = fresh(spark, "checked")
    load_checked(spark, d, f"{out}/ledger", f"{out}/rejects")
    assert spark.read.parquet(f"{out}/ledger").count() == 6 and spark.read.json(f"{out}/rejects").count() == 6


def test_lines_without_headers_and_other_separators(spark):
    d = folder({"a.txt": TEN.replace(",", ";") + "\n" + "a;b\n'x;y'" + ";1" * 9 + "\n'x;y'" + ";1" * 10})
    rows, rejects = read_checked(spark, d, header=False, sep=";", quote="'")
    assert sorted(r["txn_date"] for r in rows.collect()) == ["2024-01-15", "x;y"]
    assert sorted((r["found"], r["reason"]) for r in rejects.collect()) == [(2, "too few fields"), (11, "too many fields")]


def test_a_file_of_several_splits(spark):
    """Only the first line of a file is its header, however it is split."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        d = folder({f"{i}.csv": header(10) + "\n" + "\n".join([TEN] * 300 + ["a,b"] * 5) + "\n" for i in range(3)})
        rows, rejects = read_checked(spark, d)
        assert rows.count() == 900 and rejects.count() == 15 and rows.where("txn_date LIKE 'h%'").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folded_rollup_equals_the_whole(spark, small_ledger):
    path = fresh(spark, "state")
    part = [small_ledger.where(F.pmod(F.xxhash64("entity_name", "cash_dr"), F.lit(3)) == n) for n in range(3)]
    assert rollup_state.read_rollup(spark, path).where("level >= 0").count() == 0
    assert rollup_state.fold(part[0], path, 0) and rollup_state.fold(part[0], path, 0)
    assert same(rollup_state.read_rollup(spark, path), rollup_table(part[0]))
    assert rollup_state.compact(spark, path) == 1
    assert not rollup_state.fold(part[0], path, 0)
    assert rollup_state.fold(part[1], path, "day-2")
    # A compaction that died before its commit changes nothing.
    spark.range(1).select(F.lit("wreck").alias("txn_date")).write.parquet(f"{path}/base/gen=2")
    assert same(rollup_state.read_rollup(spark, path), rollup_table(part[0].unionByName(part[1])))
    assert rollup_state.compact(spark, path) == 2 and not rollup_state.fold(part[1], path, "day-2")
    rollup_state.fold(part[2], path, "03")
    kept = rollup_state.read_rollup(spark, path)
    assert same(kept, rollup_table(small_ledger))
    whole = rollup_table(small_ledger)
    assert rollup_lookup(kept, {"date": "1998-08-23"}).first() == rollup_lookup(whole, {"date": "1998-08-23"}).first()
    assert same(rollup_children(kept, ["1998-08-23"]), rollup_children(whole, ["1998-08-23"]))
    with pytest.raises(ValueError):
        rollup_state.fold(part[0], path, "../elsewhere")


def test_folded_sums_stay_exact(spark):
    """0.1 + 0.2 a thousand times over, with amounts off the fast path."""
    rows = [("2024-01-01", "A", "B", "C", "v", "p", 0.1, 0.2, 1e22, -1e-4)] * 1000
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c in MEASURES else 'string'}" for c in COLUMNS))
    path = fresh(spark, "state")
    for n in range(3):
        rollup_state.fold(df, path, n)
        if n == 1:
            rollup_state.compact(spark, path)
    total = rollup_state.read_rollup(spark, path).where("level = -1").first()
    assert [total[c] for c in ("row_count", *MEASURES)] == [3000, 300.0, 600.0, 3e25, -0.3]


def test_a_stream_of_files_is_folded_once(spark):
    d, path = folder({"a.csv": header(10) + "\n" + "\n".join(",".join(r) for r in SIX_ROWS[:4])}), fresh(spark, "state")
    for _ in range(2):
        rollup_state.start_rollup_ingest(spark, d, path, f"{path}-checkpoint", available_now=True).awaitTermination()
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write(header(10) + "\n" + "\n".join(",".join(r) for r in SIX_ROWS[4:]))
    rollup_state.start_rollup_ingest(spark, d, path, f"{path}-checkpoint", available_now=True).awaitTermination()
    assert same(rollup_state.read_rollup(spark, path), rollup_table(normalize(spark.createDataFrame(SIX_ROWS, RAW_SCHEMA))))


ODD = "g string, v int, w double"
ODD_ROWS = [(g, v, w) for g in (None, "a", "b") for v in (None, 1, 2) for w in (None, 0.5)] * 3


@pytest.mark.parametrize("order", [(), (("v", "desc"),), (("w", "desc"), ("g", "desc"))])
def test_a_walk_over_nulls_returns_every_row(spark, order):
    df, names = spark.createDataFrame(ODD_ROWS, ODD), ("g", "v", "w")
    want = [tuple(r) for r in df.orderBy(*[
        F.col(n).desc_nulls_last() if (n, "desc") in order else F.col(n).asc_nulls_first() for n in [k for k, _ in order] + [n for n in names if n not in dict(order)]
    ]).collect()]
    after, seen, got = (), 0, []
    while True:
        rows = seek_page(df, after, order, 4, seen, names).collect()
        if not rows:
            break
        got += [tuple(r) for r in rows]
        after, seen = next_cursor(rows, order, after, seen, names)
    assert got == want


@pytest.mark.parametrize("order", [(), (("v", "desc"),), (("w", "desc"), ("g", "desc"))])
def test_index_pages_and_ranks_with_nulls_and_repeats(spark, order):
    df, names = spark.createDataFrame(ODD_ROWS, ODD), ("g", "v", "w")
    path = fresh(spark, "index")
    write_page_index(df, path, order, names, range_rows=5)
    index = read_page_index(spark, path, order, names)
    keys = [F.col(n).asc_nulls_first() if asc else F.col(n).desc_nulls_last() for n, asc in index.keys]
    want = [tuple(r) for r in df.orderBy(*keys).collect()]
    assert index.total() == len(want) and index.page(len(want), 9).collect() == []
    for offset in (0, 3, 5, 24, 50):
        assert [tuple(r) for r in index.page(offset, 5).collect()] == want[offset : offset + 5]
        assert len(index.overlapping(offset, 5)) <= 2
    columns = [n for n, _ in index.keys]
    plain = [tuple(r[names.index(c)] for c in columns) for r in want]
    for size in (1, 2, 3):
        for key in {k[:size] for k in plain}:
            assert index.rank(key) == [k[:size] for k in plain].index(key), key
    offset, rows = index.page_at(plain[30], 4)
    assert [tuple(r) for r in rows.collect()] == want[offset : offset + 4] and plain[offset] == plain[30]


def test_a_deep_page_reads_two_ranges_at_most(spark, small_ledger):
    path, rows = fresh(spark, "index"), small_ledger.select(*COLUMNS)
    write_page_index(rows, path, range_rows=500)
    index = read_page_index(spark, path)
    for offset in (0, 480, 5480, 5990):
        got = index.page(offset, 100)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in page(rows, (), offset, 100).collect()]
        files = {r[0].rsplit("/", 2)[-2] for r in index.rows.where(F.col("range").isin(index.overlapping(offset, 100))).select(F.input_file_name()).distinct().collect()}
        assert len(files) <= 2
        text = plan(got)
        assert "range#" in text.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(row_index" in text, text
    assert index.rank(("1998-08-23",)) == rows.where("txn_date < '1998-08-23'").count()


@pytest.mark.parametrize("order", [(), (("cash_dr", "desc"),), ("particulars", ("bank_cr", "desc"))])
def test_a_tree_of_merges_gives_the_same_page(spark, small_ledger, order):
    rows = small_ledger.select(*COLUMNS).unionByName(small_ledger.select(*COLUMNS).limit(500)).repartition(60)
    for offset, limit in ((0, 40), (13, 1500)):
        want = [tuple(r) for r in page(rows, order, offset, limit).collect()]
        assert len(want) == limit
        assert [tuple(r) for r in page(rows, order, offset, limit, fan_in=4, parts=60).collect()] == want


def test_no_merge_sees_more_than_its_fan_in(spark, small_ledger):
    """60 tasks, 4 to a merge: 15, then 4 tasks; each gets 4 x 20 rows."""
    from ledgerlake.operators import paging

    seen, first = [], paging._first_of_each_task

    def spy(df, order, k):
        seen.append(df)
        return first(df, order, k)

    paging._first_of_each_task = spy
    try:
        rows = small_ledger.select(*COLUMNS).repartition(60).cache()
        last = paging.top_rows(rows, paging._sort_cols(paging.total_order(("cash_dr",))), 20, fan_in=4, parts=60)
    finally:
        paging._first_of_each_task = first
    per_task = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(seen) == 3
    for merge, tasks in zip(seen[1:], (15, 4)):
        sizes = per_task(merge)
        assert len(sizes) <= tasks and max(sizes) <= 4 * 20 + 4
    assert len(per_task(last)) <= 4 and max(per_task(last)) <= 20


def test_large_caps_sort_only_what_can_be_kept(spark):
    """A hot group of 60,000 rows, a null one, one near the cap, small ones
    and many equal rows: the first 5,000 of each, and few others numbered."""
    from ledgerlake.operators.ordinal import among_first, first_in_groups

    sizes = {"hot": 60_000, None: 20_000, "near": 5_300, "small": 30, "same": 12_000}
    rows = spark.range(60_000).select(F.explode(F.array(*[F.lit(g) for g in sizes])).alias("g"), "id")
    limit = F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(g)), F.lit(n)) for g, n in sizes.items()])
    value = F.when(F.col("g") == "same", F.lit(1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(40_000)))
    df = rows.where(F.col("id") < limit).select("g", F.when(F.col("id") % 50 != 0, value).alias("v"), "id").cache()
    got = first_in_groups(df, ["g"], ["v", "id"], 5000).collect()
    by_group: dict = {}
    for r in df.collect():
        by_group.setdefault(r["g"], []).append((r["v"] is not None, r["v"] or 0, r["id"]))
    want = {(g, i, x[2]) for g, xs in by_group.items() for i, x in enumerate(sorted(xs)[:5000])}
    assert {(r["g"], r["_n"], r["id"]) for r in got} == want and len(got) == len(want) == 4 * 5000 + 30
    assert among_first(df, ["g"], ["v", "id"], 5000).count() < 1.6 * len(want)
    assert among_first(df.where("g = 'small'"), ["g"], ["v", "id"], 5000).count() == 30


def with_nulls(spark):
    rows = [(d, t, None if i % 2 else "s", n, "v", f"p{i}", float(i), 0.0, 0.0, 1.0) for i, (d, t, n) in enumerate(
        [(d, t, n) for d in ("2024-01-01", None) for t in ("A", None) for n in ("x", None)] * 3)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c in MEASURES else 'string'}" for c in COLUMNS))


def test_nested_groups_keep_null_levels(spark):
    df = with_nulls(spark)
    got = flat_hierarchy_nested(df, chunk_rows=2).collect()
    groups = {tuple(r[d] for d in DIMS): r for r in flat_hierarchy(df).collect()}
    assert {tuple(r[d] for d in DIMS) for r in got} == set(groups)
    assert sum(len(r["transactions"]) for r in got) == df.count() == sum(g["row_count"] for g in groups.values())
    for r in got:
        assert r["row_count"] == groups[tuple(r[d] for d in DIMS)]["row_count"] and r["gross_total"] == groups[tuple(r[d] for d in DIMS)]["gross_total"]
    assert Counter(t["particulars"] for r in got for t in r["transactions"]) == Counter(r["particulars"] for r in df.collect())


def test_running_weights(spark):
    rows = [(g, i, (i * 7) % 5 + 1) for g in ("a", None, "b") for i in range(200 if g else 3000)]
    got = number_rows(spark.createDataFrame(rows, "g string, i int, w int"), ["g"], [F.col("i")], "before", partitions=7, weight="w").collect()
    for g in ("a", None, "b"):
        before = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"]):
            assert r["before"] == before
            before += r["w"]


def plain_tree(rows, dims, path=""):
    """The nested document without pieces."""
    if not dims:
        return [
            {"id": f"{path}/tx/{i}", "type": "transaction", "level": 4, "vch_type": r["vch_type"], "particulars": r["particulars"], "amounts": {m: r[m] for m in MEASURES}}
            for i, r in enumerate(rows)
        ]
    out, level = [], len(DIMS) - len(dims)
    for value in sorted({r[dims[0]] for r in rows}):
        own = [r for r in rows if r[dims[0]] == value]
        node = f"{path}/{level}/{value}"
        sums = {m: round(sum(r[m] for r in own), 4) for m in MEASURES}
        out.append({"id": node, "label": value, "count": len(own), "aggregates": sums, "children": plain_tree(own, dims[1:], node)})
    return out


def assembled(parts, path=""):
    """The document put together from its parts."""
    nodes = [n for p in sorted(parts[path]) for n in json.loads(parts[path][p])]

    def filled(n):
        if n["type"] == "transaction":
            return n
        children = n["children"] if n["parts"] == 0 else None
        children = [filled(c) for c in children] if children is not None else assembled(parts, n["id"])
        return {k: n[k] for k in ("id", "label", "count", "aggregates")} | {"children": children}

    return [filled(n) for n in nodes]


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_nested_tree_pieces_make_the_whole_document(spark, small_ledger, limit):
    hot = small_ledger.where("txn_date < '1995-03-01'").select(*COLUMNS)
    hot = hot.unionByName(hot.withColumn("txn_date", F.lit("1995-01-20")).withColumn("entity_type", F.lit('a "quoted" type'))).cache()
    rows = sort_rows(hot, ()).collect()
    parts: dict = {}
    got = nested_tree(hot, max_nodes=limit).collect()
    for r in got:
        assert r["part"] not in parts.setdefault(r["path"], {})
        parts[r["path"]][r["part"]] = r["json"]
        assert r["nodes"] <= 2 * limit
    assert assembled(parts) == plain_tree(rows, DIMS)
    assert len(got) == 1 if limit == 10_000 else len(parts["/0/1995-01-20/1/a \"quoted\" type"]) > 1
    assert nested_tree(hot.limit(0)).collect() == []
