"""Random small ledgers against brute-force Python (node table, caps)."""

from collections import defaultdict
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake import leaf_cap, node_table
from ledgerlake.schema import CLEAN_SCHEMA, COLUMNS, DIMS, MEASURES

row = st.tuples(
    st.sampled_from(["2024-01-01", "2024-01-02", "Unknown"]),
    st.sampled_from(["A", "B"]),
    st.sampled_from(["x", "y/z"]),  # a '/' inside a value must not confuse the paths
    st.sampled_from(["n1", "n2", "n3"]),
    st.sampled_from(["V"]),
    st.sampled_from(["p", "q"]),
    *[st.decimals(min_value=-1000, max_value=1000, places=2, allow_nan=False, allow_infinity=False)] * 4,
)


def _frame(spark, rows):
    data = [(*r[:6], *[float(v) for v in r[6:]], None) for r in rows]
    return spark.createDataFrame(data, CLEAN_SCHEMA)


@settings(max_examples=8, deadline=None)
@given(st.lists(row, min_size=1, max_size=40))
def test_node_table_matches_brute_force(spark, rows):
    want = defaultdict(lambda: [0, Decimal(0), Decimal(0), Decimal(0), Decimal(0)])
    for r in rows:
        for level in range(4):
            acc = want[(level, tuple(r[: level + 1]))]
            acc[0] += 1
            for i in range(4):
                acc[1 + i] += Decimal(repr(float(r[6 + i])))
    got = {}
    for n in node_table(_frame(spark, rows)).collect():
        key = (n["level"], tuple(n[d] for d in DIMS[: n["level"] + 1]))
        got[key] = [n["row_count"], *[n[m] for m in MEASURES]]
    assert set(got) == set(want)
    for k, acc in want.items():
        assert got[k][0] == acc[0]
        assert got[k][1:] == [float(v) for v in acc[1:]]


@settings(max_examples=8, deadline=None)
@given(st.lists(row, min_size=1, max_size=40), st.integers(min_value=1, max_value=4))
def test_leaf_cap_matches_brute_force(spark, rows, cap):
    frame = [(*r[:6], *[float(v) for v in r[6:]]) for r in rows]
    leaves = defaultdict(list)
    for r in frame:
        leaves[r[:4]].append(r)
    want = sorted(r for rs in leaves.values() for r in sorted(rs)[:cap])
    got = sorted(tuple(x[c] for c in COLUMNS) for x in leaf_cap(_frame(spark, rows), cap).collect())
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="0123456789eE+-.dfnaix_, \t ", max_size=8), min_size=1, max_size=50))
def test_number_rule_matches_python(spark, values):
    import re

    from pyspark.sql import functions as F

    from ledgerlake.functions import cleaning as C

    def rule(v):
        s = v.strip(C.WHITESPACE)
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s):
            return 0.0
        x = float(s)
        return x if abs(x) < 1e24 else 0.0

    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(C.clean_number(F.col("v"))).collect()]
    assert got == [rule(v) for v in values]
    # The staged normalize applies the same rule.
    from ledgerlake import normalize
    from ledgerlake.schema import RAW_SCHEMA

    raw = spark.createDataFrame([(str(i), "T", "S", "N", "V", "P", v, "0", "0", "0") for i, v in enumerate(values)], RAW_SCHEMA)
    staged = [r["cash_dr"] for r in normalize(raw).collect()]
    assert sorted(staged) == sorted(rule(v) for v in values)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(row, min_size=1, max_size=40),
    st.integers(min_value=0, max_value=45),
    st.integers(min_value=1, max_value=20),
    st.booleans(),
)
def test_page_matches_python_slice(spark, rows, offset, limit, deep):
    from ledgerlake.operators import paging

    frame = sorted((*r[:6], *[float(v) for v in r[6:]]) for r in rows)
    cut = paging.numbered_page if deep else paging.page
    got = [tuple(x[c] for c in COLUMNS) for x in cut(_frame(spark, rows), (), offset, limit).collect()]
    assert got == frame[offset : offset + limit]
