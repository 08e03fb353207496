"""Totals, profile and filter options.

Each is a single aggregation: partial aggregates run next to the scan and
only one small row per task crosses the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.aggregates import totals_of
from ledgerlake.functions.predicates import LedgerFilter
from ledgerlake.operators.filters import apply_filter
from ledgerlake.functions.cleaning import day_of
from ledgerlake.schema import COLUMNS, DIMS, UNKNOWN


def totals(df: DataFrame, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """One row: ``row_count`` + the four exact sums; zeros when nothing matches."""
    return totals_of(apply_filter(df, spec), gross=False)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Load report: rows, columns, real date range, unknown dates, distinct
    entity types / sub types / names (exact unless ``approx``), and numeric
    and date rejects (not blank, no layout fits) when the ledger was cleaned
    with ``with_rejects=True``.

    Two aggregation levels: rows are first reduced per (type, sub type,
    name) with a map-side partial aggregate, so the distinct counts (which
    Spark evaluates by expanding its input once per distinct column) run
    over entities instead of over every ledger row.
    """
    distinct = F.approx_count_distinct if approx else F.count_distinct
    day = day_of(df.columns)
    entity = ["entity_type", "entity_sub_type", "entity_name"]
    per = [
        F.count(F.lit(1)).alias("_n"),
        F.min(day).alias("_lo"),
        F.max(day).alias("_hi"),
        F.count(F.when(F.col("txn_date") == UNKNOWN, 1)).alias("_u"),
    ]
    if "numeric_rejects" in df.columns:
        per.append(F.sum("numeric_rejects").alias("_r"))
    if "date_rejects" in df.columns:
        per.append(F.sum("date_rejects").alias("_d"))
    per_entity = df.groupBy(*entity).agg(*per)
    aggs = [
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.lit(len(COLUMNS)).alias("column_count"),
        F.date_format(F.min("_lo"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max("_hi"), "yyyy-MM-dd").alias("end_date"),
        F.coalesce(F.sum("_u"), F.lit(0)).cast("bigint").alias("unknown_dates"),
        distinct("entity_type").alias("entity_types"),
        distinct("entity_sub_type").alias("entity_sub_types"),
        distinct("entity_name").alias("entity_names"),
    ]
    if "numeric_rejects" in df.columns:
        aggs.append(F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("numeric_rejects"))
    if "date_rejects" in df.columns:
        aggs.append(F.coalesce(F.sum("_d"), F.lit(0)).cast("bigint").alias("date_rejects"))
    return per_entity.agg(*aggs)


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct values of each level in long form ``(dimension, value)``,
    sorted. Not cascading: other filters do not narrow the lists."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in DIMS])
    ).alias("p")
    return (
        df.select(*DIMS)
        .select(pairs)
        .select("p.dimension", "p.value")
        .distinct()
        .orderBy("dimension", "value")
    )
