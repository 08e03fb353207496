"""Synthetic ledger generator (S8), fully distributed and repeatable.

Each input row becomes one ledger row; every random draw is an integer mix
of the row's key and the seed, so the same keys and seed always give the
same ledger, on any number of executors. Exactly one of the four
measures is non-zero; the sub type and name always belong to the type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.schema import COLUMNS, MEASURES

# Vocabulary of the sample ledger.
ENTITY_TYPES = ["Customer", "Vendor", "Bank", "Employee", "Partner"]
SUB_TYPES = {
    "Customer": ["Retail", "Wholesale", "Online", "Corporate"],
    "Vendor": ["Service", "Goods", "Wholesale", "Utility"],
    "Bank": ["Savings", "Current", "Loan", "Finance"],
    "Employee": ["Salary", "Reimbursement", "Bonus", "Advance"],
    "Partner": ["Investment", "Distribution", "Commission", "Profit Share"],
}
NAMES = {
    "Customer": ["ABC Corp", "XYZ Ltd", "Global Inc", "Tech Solutions", "Retail Pro"],
    "Vendor": ["Office Supplies Co", "Utility Corp", "Service Provider", "Material Mart"],
    "Bank": ["National Bank", "State Bank", "Commercial Bank", "Finance Bank"],
    "Employee": ["John Doe", "Jane Smith", "Bob Johnson", "Alice Williams"],
    "Partner": ["Partner A", "Partner B", "Partner C", "Investor D"],
}
VCH_TYPES = ["Receipt", "Payment", "Journal", "Contra", "Sales", "Purchase"]
PARTICULARS = [
    "Payment received", "Payment made", "Service charge", "Product sale",
    "Material purchase", "Salary payment", "Commission paid", "Interest earned",
    "Interest paid", "Bank charges", "Rent received", "Rent paid",
    "Invoice settlement", "Advance received", "Advance payment",
]
MIN_AMOUNT, MAX_AMOUNT = 100.0, 50000.0
DAYS_BACK = 30

# Draw mixer: integer multiply / modulo / xor-shift only, so any SQL
# engine computes the same draws (all products stay below 2^62).
_M = 2147483647
_A0 = 48271
_DRAW_MULT = [16807, 69621, 39373, 950706376, 742938285, 1226874159, 62089911, 1343714438]


def _draws(keys: DataFrame, key_sql: str, seed: int) -> DataFrame:
    """Add ``_d1`` .. ``_d8``: eight pseudo-random non-negative ints per row."""
    x = keys.select(F.expr(f"(({key_sql}) % {_M}) * {_A0} + {seed % _M}").alias("_x"))
    x = x.select(F.expr(f"_x % {_M}").alias("_x"))
    x = x.select(F.expr("_x ^ shiftright(_x, 13)").alias("_y"))
    out = []
    for i, a in enumerate(_DRAW_MULT, start=1):
        d = f"((_y * {a}) % {_M})"
        out.append(F.expr(f"{d} ^ shiftright({d}, 11)").alias(f"_d{i}"))
    return x.select(*out)


def _pick(values: list[str], draw: str) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.col(draw) % len(values) + 1).cast("int"))


def _pick_by_type(mapping: dict[str, list[str]], draw: str) -> Column:
    out = F.lit(None).cast("string")
    for t, values in mapping.items():
        out = F.when(F.col("entity_type") == t, _pick(values, draw)).otherwise(out)
    return out


def generate_ledger(keys: DataFrame, key_sql: str = "id", seed: int = 0, end_date: str = "2024-01-31") -> DataFrame:
    """One synthetic row per row of ``keys``, drawn from the integer key
    expression ``key_sql`` (dates in the ``DAYS_BACK`` days up to
    ``end_date``). Output: the 10 ledger columns + ``txn_day``. Narrow: no
    shuffle, so it scales with the key table."""
    d = _draws(keys, key_sql, seed)
    d = d.withColumn("entity_type", _pick(ENTITY_TYPES, "_d1"))
    cents = F.col("_d6") % F.lit(int((MAX_AMOUNT - MIN_AMOUNT) * 100) + 1) + F.lit(int(MIN_AMOUNT * 100))
    amount = cents.cast("double") / F.lit(100.0)
    which = F.col("_d7") % F.lit(len(MEASURES))
    start = F.date_sub(F.to_date(F.lit(end_date)), DAYS_BACK)
    day = F.date_add(start, (F.col("_d5") % F.lit(DAYS_BACK + 1)).cast("int"))
    return d.select(
        F.date_format(day, "yyyy-MM-dd").alias("txn_date"),
        F.col("entity_type"),
        _pick_by_type(SUB_TYPES, "_d2").alias("entity_sub_type"),
        _pick_by_type(NAMES, "_d3").alias("entity_name"),
        _pick(VCH_TYPES, "_d4").alias("vch_type"),
        _pick(PARTICULARS, "_d8").alias("particulars"),
        *[F.when(which == i, amount).otherwise(F.lit(0.0)).alias(m) for i, m in enumerate(MEASURES)],
        day.alias("txn_day"),
    ).select(*COLUMNS, "txn_day")


def generate_rows(spark: SparkSession, n: int, seed: int = 0, end_date: str = "2024-01-31") -> DataFrame:
    """``n`` synthetic rows keyed by ``spark.range(n)``."""
    return generate_ledger(spark.range(n), "id", seed, end_date)
