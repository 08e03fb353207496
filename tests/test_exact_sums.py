"""Limb sums equal exact decimal sums, whatever the values and order."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.functions.aggregates import exact_sum, measure_aggs
from ledgerlake.functions.cleaning import clean_number, number_rejected

amounts = st.decimals(min_value=Decimal("-1e20"), max_value=Decimal("1e20"), places=2,
                      allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(amounts, min_size=0, max_size=60))
def test_limb_sum_equals_decimal_sum(spark, values):
    rows = [(float(v),) for v in values]
    df = spark.createDataFrame(rows, "cash_dr double")
    got = df.agg(exact_sum("cash_dr").alias("s")).first()["s"]
    want = sum((Decimal(repr(float(v))).quantize(Decimal("0.0001"), ROUND_HALF_UP) for v in values), Decimal(0))
    assert got == want


def test_order_does_not_matter(spark):
    vals = [0.1, 0.2, 0.3, 1e11 + 0.07, -1e11, 123.45, -0.01] * 500
    a = spark.createDataFrame([(v, 0.0, 0.0, 0.0) for v in vals], "cash_dr double, cash_cr double, bank_dr double, bank_cr double")
    b = spark.createDataFrame([(v, 0.0, 0.0, 0.0) for v in reversed(vals)], a.schema).repartition(7)
    ra = a.agg(*measure_aggs()).first()
    rb = b.agg(*measure_aggs()).first()
    assert ra == rb
    assert ra["cash_dr"] == float(sum(Decimal(repr(v)) for v in vals))
    assert ra["gross_total"] == ra["cash_dr"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_range_of_amounts(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for text in ("9e14", "1e16", "-715514749187.93", "9.99e23", "0.00005", "123456789.12345"):
            df = spark.createDataFrame([(float(text),), (None,)], "cash_dr double")
            want = Decimal(repr(float(text))).quantize(Decimal("0.0001"), ROUND_HALF_UP)
            assert df.agg(exact_sum("cash_dr").alias("s")).first()["s"] == want
        for bad in (1e24, float("nan"), float("-inf")):
            with pytest.raises(Exception, match="amount out of range"):
                spark.createDataFrame([(bad,)], "cash_dr double").agg(exact_sum("cash_dr")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_cleaning_rejects_what_sums_cannot_hold(spark):
    df = spark.createDataFrame([("1e24",), ("-1e30",), ("9e23",)], "v string")
    got = [tuple(r) for r in df.select(clean_number(F.col("v")), number_rejected(F.col("v"))).collect()]
    assert got == [(0.0, 1), (0.0, 1), (9e23, 0)]
