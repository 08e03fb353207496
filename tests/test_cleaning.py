"""Dirty values (FIXTURES.md section 3) and input shapes."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as C
from ledgerlake.operators.normalize import normalize
from ledgerlake.operators.totals import profile, totals
from ledgerlake.schema import RAW_SCHEMA
from ledgerlake.sources.ledger import positional

DATES = [
    ("2024-01-15", "2024-01-15"),
    ("2024-01-16 10:00", "2024-01-16"),
    ("01/02/2024", "2024-01-02"),
    ("15/02/2024", "2024-02-15"),
    ("Jan 3 2024", "2024-01-03"),
    (" 2024-01-15\t", "2024-01-15"),
    ("x", "Unknown"),
    ("45000", "Unknown"),
    ("", "Unknown"),
    (None, "Unknown"),
]
TEXTS = [
    (" ABC Corp ", "ABC Corp"),
    ("\tABC Corp ", "ABC Corp"),
    (None, "Unknown"),
    ("", "Unknown"),
    ("   ", "Unknown"),
    ("nan", "Unknown"),
    ("NaN", "Unknown"),
    ("None", "Unknown"),
    ("NA", "Unknown"),
    ("N/A", "Unknown"),
    ("null", "Unknown"),
    ("NULL", "Unknown"),
    ("Nan Corp", "Nan Corp"),
]
NUMBERS = [
    ("1e3", 1000.0, 0),
    (" 12 ", 12.0, 0),
    ("+4", 4.0, 0),
    ("-3.5", -3.5, 0),
    (".5", 0.5, 0),
    ("1,234", 0.0, 1),
    ("(5)", 0.0, 1),
    ("₹5", 0.0, 1),
    ("abc", 0.0, 1),
    ("1d", 0.0, 1),
    ("1f", 0.0, 1),
    ("0x10", 0.0, 1),
    ("1_0", 0.0, 1),
    (None, 0.0, 0),
    ("", 0.0, 0),
    ("nan", 0.0, 1),
    ("inf", 0.0, 1),
    ("1e999", 0.0, 1),
]


@pytest.mark.parametrize("raw,expected", DATES)
def test_dates(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(C.date_text(C.parse_day(F.col("v")))).first()[0] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-15T10:00:00", "2024-01-15"), ("2024-01-15 10:00:00.123", "2024-01-15"),
        ("2024-01-15T23:30:00+05:30", "2024-01-15"), ("2024-01-15T23:30:00Z", "2024-01-15"),
        ("15-01-2024", "2024-01-15"), ("01-02-2024", "2024-01-02"), ("1-Apr-2024", "2024-04-01"),
        ("01-Apr-2024", "2024-04-01"), ("15 January 2024", "2024-01-15"), ("2024/01/15", "2024-01-15"),
        ("January 3, 2024", "2024-01-03"), ("Jan 3, 2024", "2024-01-03"), ("May 3 2024", "2024-05-03"),
        ("01/02/24", "2024-01-02"), ("15/01/24", "2024-01-15"), ("1/2/2024 10:30", "2024-01-02"),
        ("20240115", "Unknown"), ("2024-13-45", "Unknown"), ("2024-01-15T25:00:00", "Unknown"), ("31-Foo-2024", "Unknown"),
    ],
)
def test_date_layouts(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    got = df.select(C.date_text(C.parse_day(F.col("v"))), C.date_rejected(F.col("v"), C.parse_day(F.col("v")))).first()
    assert tuple(got) == (expected, int(expected == "Unknown"))


@pytest.mark.parametrize("raw,expected", TEXTS)
def test_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(C.clean_text(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("raw,expected,rejected", NUMBERS)
def test_numbers(spark, raw, expected, rejected):
    df = spark.createDataFrame([(raw,)], "v string")
    got = df.select(C.clean_number(F.col("v")), C.number_rejected(F.col("v"))).first()
    assert (got[0], got[1]) == (expected, rejected)


def _raw(spark, ncols, rows=1):
    names = [f"odd header {i}" for i in range(ncols)]
    data = [tuple(["2024-01-15", "T", "S", "N", "V", "P", "1", "2", "3", "4"][:ncols] + ["x"] * (ncols - 10))] * rows
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def test_nine_columns_is_an_error(spark):
    with pytest.raises(ValueError, match="10 columns, this one has 9"):
        positional(_raw(spark, 9))


def test_ten_and_eleven_columns(spark):
    for n in (10, 11):
        out = normalize(_raw(spark, n))
        assert out.columns[:10] == ["txn_date", "entity_type", "entity_sub_type", "entity_name", "vch_type",
                                    "particulars", "cash_dr", "cash_cr", "bank_dr", "bank_cr"]
        r = out.first()
        assert (r["entity_type"], r["bank_cr"]) == ("T", 4.0)


def test_zero_rows(spark):
    empty = normalize(spark.createDataFrame([], RAW_SCHEMA))
    p = profile(empty).first()
    assert p["row_count"] == 0 and p["start_date"] is None
    t = totals(empty).first()
    assert (t["row_count"], t["cash_dr"], t["bank_cr"]) == (0, 0.0, 0.0)


def test_drop_zero_rows_keeps_offsetting_values(spark):
    rows = [
        ("2024-01-15", "T", "S", "N", "V", "P", "0", "0", "0", "0"),
        ("2024-01-15", "T", "S", "N", "V", "P", "5", "-5", "0", "0"),
    ]
    df = normalize(spark.createDataFrame(rows, RAW_SCHEMA), drop_zero_rows=True)
    assert df.count() == 1


def test_normalize_is_idempotent(small_ledger):
    once = normalize(small_ledger)
    twice = normalize(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert small_ledger.drop("txn_day").exceptAll(once.drop("txn_day")).count() == 0


def test_typed_columns(spark):
    import datetime as dt

    df = spark.createDataFrame(
        [(dt.date(2024, 1, 15), "T", "S", "N", "V", "P", 1.5, float("nan"), None, 2.0)],
        "d date, a string, b string, c string, e string, f string, g double, h double, i double, j double",
    )
    r = normalize(df, with_rejects=True).first()
    assert (r["txn_date"], r["cash_dr"], r["cash_cr"], r["bank_dr"], r["numeric_rejects"]) == ("2024-01-15", 1.5, 0.0, 0.0, 1)
