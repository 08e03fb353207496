"""Report outputs: export with a TOTAL row (S6, U1) and the documented
report shapes R1-R5, each a thin composition of filters and aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.aggregates import group_measures, totals_of
from ledgerlake.functions.predicates import LedgerFilter
from ledgerlake.operators.filters import apply_filter
from ledgerlake.operators.rollup import rollup_table
from ledgerlake.functions.cleaning import day_of
from ledgerlake.schema import COLUMNS, MEASURES, UNKNOWN

TOTAL_LABEL = "TOTAL"


def export_report(
    df: DataFrame, spec: LedgerFilter | Mapping | None = None, include_totals: bool = True
) -> DataFrame:
    """Filtered rows + one TOTAL row (text cells blank, ``particulars`` =
    ``TOTAL``, measures summed). ``is_total`` keeps measures numeric and
    sorts the TOTAL row last."""
    rows = apply_filter(df, spec).select(*COLUMNS)
    out = rows.withColumn("is_total", F.lit(False))
    if not include_totals:
        return out
    text = {c: F.lit("") for c in COLUMNS[:6]}
    text["particulars"] = F.lit(TOTAL_LABEL)
    total = totals_of(rows, gross=False).select(
        *[text[c].alias(c) for c in COLUMNS[:6]], *MEASURES, F.lit(True).alias("is_total")
    )
    return out.unionByName(total)


def monthly_reconciliation(df: DataFrame, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """Per month and entity, Dr/Cr sums and the cash and bank nets."""
    month = F.coalesce(F.date_format(day_of(df.columns), "yyyy-MM"), F.lit(UNKNOWN)).alias("month")
    rows = apply_filter(df, spec).withColumn("month", month)
    return group_measures(rows, ["month", "entity_type", "entity_sub_type", "entity_name"], gross=False, nets=True)


def entity_rollup(df: DataFrame, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """R2: type -> sub type -> name subtotals and the grand total."""
    return rollup_table(df, spec, dims=["entity_type", "entity_sub_type", "entity_name"])


def cash_vs_bank(df: DataFrame, spec: LedgerFilter | Mapping | None = None, by: str = "entity_type") -> DataFrame:
    """Per ``by`` value, one row per channel (cash, bank): dr, cr, net."""
    agg = group_measures(apply_filter(df, spec), [by], gross=False, nets=True)
    return agg.select(
        by,
        F.expr(
            "stack(2, 'cash', cash_dr, cash_cr, cash_net, 'bank', bank_dr, bank_cr, bank_net)"
            " AS (channel, dr, cr, net)"
        ),
    )


def date_range(
    df: DataFrame, start: str, end: str, spec: LedgerFilter | Mapping | None = None
) -> DataFrame:
    """Rows with a real date in ``[start, end]``; Unknown dates excluded."""
    day = day_of(df.columns)
    rows = apply_filter(df, spec).filter(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if "txn_month" in df.columns:
        # Same rows, but lets a month-partitioned ledger prune directories.
        rows = rows.filter(F.col("txn_month").between(F.lit(start[:7]), F.lit(end[:7])))
    return rows.select(*COLUMNS)


def audit_trail(df: DataFrame, entity_name: str) -> DataFrame:
    """Every row of one entity, in date order (then all columns)."""
    return apply_filter(df, {"entity_name": entity_name}).select(*COLUMNS).orderBy(*COLUMNS)


def range_totals(df: DataFrame, start: str, end: str, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """Totals of a date range (R4 with A1)."""
    return totals_of(date_range(df, start, end, spec), gross=False)
