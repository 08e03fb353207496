"""Row filters (F1-F8)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ledgerlake.functions.predicates import GridFilter, LedgerFilter


def apply_filter(df: DataFrame, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """AND of equalities on the levels; an empty spec keeps every row.

    The predicate is a plain ``Filter`` so Catalyst pushes it to the scan.
    """
    f = LedgerFilter.of(spec)
    if f.is_empty():
        return df
    return df.filter(f.predicate(df.columns))


def grid_filter(df: DataFrame, *conditions: tuple) -> DataFrame:
    """Per-column grid conditions ``(column, op, value[, value2])``, ANDed."""
    if not conditions:
        return df
    return df.filter(GridFilter(tuple(conditions)).predicate())
