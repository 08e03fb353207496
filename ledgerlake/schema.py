"""Ledger schema: one fixed, positional, 10-column table.

Files are read by position (headers are ignored), so the only names that
matter are the snake_case ones below. ``DISPLAY_NAMES`` maps them to the
labels users see in reports and filter specs.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column order, display labels and roles of the ledger.
COLUMNS = [
    "txn_date",
    "entity_type",
    "entity_sub_type",
    "entity_name",
    "vch_type",
    "particulars",
    "cash_dr",
    "cash_cr",
    "bank_dr",
    "bank_cr",
]
DISPLAY_NAMES = {
    "txn_date": "Date",
    "entity_type": "Entity Type",
    "entity_sub_type": "Entity Sub Type",
    "entity_name": "Entity Name",
    "vch_type": "Vch Type",
    "particulars": "Particulars",
    "cash_dr": "Cash Dr (R)",
    "cash_cr": "Cash Cr (P)",
    "bank_dr": "Bank Dr (R)",
    "bank_cr": "Bank Cr (P)",
}
# Drill-down levels 0..3, outermost first.
DIMS = ["txn_date", "entity_type", "entity_sub_type", "entity_name"]
TEXT_COLUMNS = ["entity_type", "entity_sub_type", "entity_name", "vch_type", "particulars"]
MEASURES = ["cash_dr", "cash_cr", "bank_dr", "bank_cr"]
UNKNOWN = "Unknown"

# Parsed date next to the display string; null when the date is Unknown.
DAY_COLUMN = "txn_day"

# Filter specs use snake_case keys; also accept the display labels.
SPEC_KEYS = {"date": "txn_date", **{c: c for c in DIMS}}
SPEC_KEYS.update({DISPLAY_NAMES[c]: c for c in DIMS})

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in COLUMNS])

CLEAN_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in COLUMNS[:6]]
    + [T.StructField(c, T.DoubleType(), False) for c in MEASURES]
    + [T.StructField(DAY_COLUMN, T.DateType(), True)]
)

# Default total order for rows: the four levels, then every other column.
ROW_ORDER = list(COLUMNS)


def dim_level(column: str) -> int:
    return DIMS.index(column)


def spec_column(key: str) -> str:
    """Map a filter key (snake_case or display label) to a ledger column."""
    try:
        return SPEC_KEYS[key]
    except KeyError:
        raise KeyError(f"unknown filter key {key!r}; expected one of {sorted(SPEC_KEYS)}") from None
