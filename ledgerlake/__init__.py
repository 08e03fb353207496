"""Ledger analytics on Spark: cleaning, filters, exact totals, four-level
drill-down, paging and reports, all as DataFrame operators."""

from ledgerlake.functions.formatting import format_amount, format_inr
from ledgerlake.functions.predicates import GridFilter, LedgerFilter
from ledgerlake.operators.filters import apply_filter, grid_filter
from ledgerlake.operators.nested import nested_tree
from ledgerlake.operators.normalize import normalize
from ledgerlake.operators.page_index import read_page_index, write_page_index
from ledgerlake.operators.paging import page, page_meta, seek_page, sort_rows
from ledgerlake.operators.reports import (
    audit_trail,
    cash_vs_bank,
    date_range,
    entity_rollup,
    export_report,
    monthly_reconciliation,
    range_totals,
)
from ledgerlake.operators.rollup import (
    flat_hierarchy,
    flat_hierarchy_nested,
    group_lookup,
    level_summary,
    rollup_children,
    rollup_lookup,
    rollup_table,
    write_rollup,
)
from ledgerlake.operators.totals import filter_options, profile, totals
from ledgerlake.operators.tree import (
    browse,
    children,
    hierarchy,
    leaf_cap,
    leaf_nodes,
    leaf_overflow,
    node_table,
    transactions,
)
from ledgerlake.sources.generator import generate_ledger, generate_rows
from ledgerlake.sources.ledger import read_ledger
from ledgerlake.sources.quarantine import load_checked, read_checked
from ledgerlake.sources.sinks import json_records, read_saved_ledger, write_ledger, write_report
from ledgerlake.sources.workbook import read_workbooks
from ledgerlake.streaming.ingest import ledger_stream, start_ingest

__all__ = [
    "GridFilter", "LedgerFilter", "apply_filter", "grid_filter", "normalize", "page", "page_meta", "seek_page",
    "sort_rows", "audit_trail", "cash_vs_bank", "date_range", "entity_rollup", "export_report",
    "monthly_reconciliation", "range_totals", "flat_hierarchy", "flat_hierarchy_nested", "group_lookup",
    "level_summary", "rollup_table", "filter_options", "profile", "totals", "browse", "children", "hierarchy",
    "leaf_cap", "leaf_nodes", "leaf_overflow", "node_table", "transactions", "generate_ledger", "generate_rows",
    "read_ledger", "read_workbooks", "read_saved_ledger", "json_records", "write_ledger", "write_report", "ledger_stream",
    "start_ingest", "format_amount", "format_inr", "write_rollup", "rollup_lookup", "rollup_children",
    "nested_tree", "read_page_index", "write_page_index", "load_checked", "read_checked",
]
