import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

# The six-row ledger used by the reference's own test.
SIX_ROWS = [
    ("2024-01-15", "Customer", "Retail", "ABC Corp", "Receipt", "Payment received", "10000", "0", "0", "0"),
    ("2024-01-15", "Customer", "Retail", "ABC Corp", "Receipt", "Second payment", "5000", "0", "0", "0"),
    ("2024-01-16", "Vendor", "Wholesale", "XYZ Ltd", "Payment", "Vendor payment", "0", "3000", "0", "0"),
    ("2024-01-16", "Vendor", "Service", "DEF Services", "Payment", "Service fee", "0", "2000", "0", "0"),
    ("2024-01-17", "Customer", "Online", "GHI Inc", "Receipt", "Online sale", "0", "0", "15000", "0"),
    ("2024-01-17", "Bank", "Finance", "Bank of Test", "Interest", "Interest earned", "0", "0", "500", "0"),
]


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import local_session

    s = local_session("*", shuffle_partitions=8, app="ledgerlake-tests")
    yield s


@pytest.fixture(scope="session")
def six(spark):
    from ledgerlake.operators.normalize import normalize
    from ledgerlake.schema import RAW_SCHEMA

    raw = spark.createDataFrame(SIX_ROWS, RAW_SCHEMA)
    return normalize(raw).cache()


@pytest.fixture(scope="session")
def small_ledger(spark):
    from ledgerlake.sources.tables import ledger_from_tables

    return ledger_from_tables(spark, SF_SMALL).cache()
