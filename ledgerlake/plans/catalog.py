"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the whole driver tables (through the ledger view or the
dirty ``events`` projection) and returns a DataFrame. No rows are collected
here. Queries that number whole leaves checkpoint their ranges when built,
and those on saved data write it then. Parameters live in ``params`` and are shared with the
DuckDB oracle texts in ``oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as C
from ledgerlake.functions.formatting import format_amount, format_inr
from ledgerlake.operators import nested, page_index, paging, reports, rollup, rollup_state, totals, tree
from ledgerlake.operators.filters import apply_filter, grid_filter
from ledgerlake.operators.normalize import normalize
from ledgerlake.operators.ordinal import SLICE_BYTES, partition_count
from ledgerlake.plans import params as P
from ledgerlake.schema import COLUMNS, MEASURES
from ledgerlake.session import shared_dir
from ledgerlake.sources.generator import generate_ledger
from ledgerlake.sources.ledger import read_ledger
from ledgerlake.sources.quarantine import read_checked
from ledgerlake.sources.tables import RAW_COLUMNS, dirty_events, dirty_lines, ledger_from_tables, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def _dirty_clean(spark: SparkSession, sf_dir: str, **opts) -> DataFrame:
    raw = dirty_events(spark, sf_dir).select(*RAW_COLUMNS, "extra_col")
    return normalize(raw, **opts)


def _ledger_query(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ledger_from_tables(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


def _normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty_events(spark, sf_dir)
    return d.select("event_id", "raw_date", C.date_text(C.parse_day(F.col("raw_date"))).alias("txn_date"))


def _normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty_events(spark, sf_dir)
    names = ["entity_type", "entity_sub_type", "entity_name", "vch_type", "particulars"]
    return d.select("event_id", *[C.clean_text(F.col(r)).alias(n) for r, n in zip(RAW_COLUMNS[1:6], names)])


def _normalize_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty_events(spark, sf_dir)
    raw = RAW_COLUMNS[6:]
    rejects = sum((C.number_rejected(F.col(r)) for r in raw[1:]), C.number_rejected(F.col(raw[0])))
    return d.select(
        "event_id",
        *[C.clean_number(F.col(r)).alias(m) for r, m in zip(raw, MEASURES)],
        rejects.alias("numeric_rejects"),
    )


def _generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One synthetic row per lineitem row, keyed by its identifying columns.
    keys = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return generate_ledger(keys, P.GEN_KEY, seed=P.GEN_SEED, end_date=P.GEN_END).select(*COLUMNS)


def _large(df: DataFrame) -> DataFrame:
    """The ledger with amounts of 1e12 to 1e15."""
    return df.withColumns({m: F.col(m) * P.LARGE_FACTOR for m in MEASURES})


def _saved_rollup(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """A query on a rollup that was saved once (here: for this query)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_dir(spark, f"rollup-{uuid.uuid4().hex}")
        rollup.write_rollup(ledger_from_tables(spark, sf_dir), path)
        return fn(spark.read.parquet(path))

    return run


def _read_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty ledger written as CSV files, then read, cleaned and
    profiled as a user's files would be."""
    path = shared_dir(spark, f"csv-{uuid.uuid4().hex}")
    dirty_events(spark, sf_dir).select(*RAW_COLUMNS, "extra_col").write.option("header", True).csv(path)
    raw = read_ledger(spark, path, "csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return totals.profile(normalize(raw, with_rejects=True))


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dirty ledger written as CSV lines of differing widths, in folders
    with differing headers, and read with its malformed lines kept apart."""
    base = shared_dir(spark, f"lines-{uuid.uuid4().hex}")
    lines = dirty_lines(spark, sf_dir)
    for folder, width in enumerate(P.LINE_HEADERS):
        # One column, whose name is the header line; written as it stands.
        text = lines.where(F.col("folder") == folder).select(F.col("line").alias(",".join(f"c{i}" for i in range(width))))
        text.write.options(header=True, sep="\x01", quote="", escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(
            f"{base}/{folder}"
        )
    return read_checked(spark, f"{base}/*")


def _ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[1].select("line", "found", "expected", "reason")


def _saved_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger joined once, for queries that read it again and again."""
    path = shared_dir(spark, f"ledger-{uuid.uuid4().hex}")
    _rows(ledger_from_tables(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def _rollup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger folded batch by batch, with retries and a compaction on
    the way."""
    path = shared_dir(spark, f"state-{uuid.uuid4().hex}")
    ledger = _saved_ledger(spark, sf_dir)
    batch = F.pmod(F.xxhash64(*COLUMNS), F.lit(P.FOLDED_BATCHES))
    for n in range(P.FOLDED_BATCHES):
        rows = ledger.where(batch == n)
        rollup_state.fold(rows, path, n)
        if n == 0:
            rollup_state.fold(rows, path, n)
        if n == 1:
            rollup_state.compact(spark, path)
            rollup_state.fold(rows, path, n)
    return rollup_state.read_rollup(spark, path)


def _indexed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut out of two saved orders: shallow, beyond the end, at a key
    and in the order of a user's sort."""
    path = shared_dir(spark, f"pages-{uuid.uuid4().hex}")
    ledger = _rows(ledger_from_tables(spark, sf_dir))
    # By the tables' size: sorted and compressed, rows say little of theirs.
    size = {"range_rows": P.INDEX_RANGE_ROWS, "partitions": partition_count(ledger, None, SLICE_BYTES)}
    page_index.write_page_index(ledger, f"{path}/plain", **size)
    plain = page_index.read_page_index(spark, f"{path}/plain")
    # The first index holds the joined ledger: nothing is joined or saved again.
    page_index.write_page_index(_rows(plain.rows), f"{path}/sorted", P.USER_SORT, **size)
    by_cash = page_index.read_page_index(spark, f"{path}/sorted", P.USER_SORT)
    pages = {
        "shallow": plain.page(P.PAGE_OFFSET, P.PAGE_LIMIT),
        "deep": plain.page(plain.total() - P.DEEP_FROM_END, P.DEEP_LIMIT),
        "key": plain.page_at(P.SEEK_AFTER, P.SEEK_LIMIT)[1],
        "sorted": by_cash.page(P.SORTED_OFFSET, P.USER_SORT_LIMIT),
    }
    named = [df.select(F.lit(name).alias("page"), *COLUMNS) for name, df in pages.items()]
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out


def _page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paging.page(ledger_from_tables(spark, sf_dir), (), P.PAGE_OFFSET, P.PAGE_LIMIT)
    return rows.select(F.to_json(F.struct(*COLUMNS)).alias("record"))


def queries() -> dict[str, Query]:
    L = _ledger_query
    q: dict[str, Query] = {
        "totals": L(lambda df: totals.totals(df)),
        "totals_filtered": L(lambda df: totals.totals(df, {"date": P.BUSY_DAY})),
        "totals_empty": L(lambda df: totals.totals(df, {"entity_type": P.MISSING})),
        "filter_date": L(lambda df: _rows(apply_filter(df, {"date": P.DAY}))),
        "filter_entity_type": L(lambda df: _rows(apply_filter(df, {"entity_type": P.TYPE}))),
        "filter_multi": L(
            lambda df: _rows(
                apply_filter(df, {"entity_type": P.TYPE, "entity_sub_type": P.SUB_TYPE, "entity_name": P.NAME})
            )
        ),
        "filter_none": L(lambda df: _rows(apply_filter(df, {}))),
        "text_filter": L(lambda df: _rows(grid_filter(df, *P.TEXT_CONDITIONS))),
        "text_filter_more": L(lambda df: _rows(grid_filter(df, *P.TEXT_CONDITIONS_MORE))),
        "number_filter_more": L(lambda df: _rows(grid_filter(df, *P.NUMBER_CONDITIONS_MORE))),
        "totals_large": L(lambda df: totals.totals(_large(df))),
        "rollup_large": L(lambda df: rollup.rollup_table(_large(df))),
        "saved_rollup_lookup": _saved_rollup(lambda r: rollup.rollup_lookup(r, {"date": P.BUSY_DAY})),
        "saved_rollup_children": _saved_rollup(lambda r: rollup.rollup_children(r, P.EXPAND_PATH)),
        "saved_rollup_options": _saved_rollup(rollup.rollup_options),
        "read_ledger": _read_ledger,
        "sort_by_date": L(lambda df: _rows(paging.sort_rows(df, (("txn_date", "desc"),)))),
        "seek_page_dup": L(
            lambda df: paging.seek_page(
                df.select(*P.DUP_KEYS), P.DUP_AFTER, (), P.SEEK_LIMIT, seen=P.DUP_SEEN, tie_break=P.DUP_KEYS
            )
        ),
        "numbered_page": L(lambda df: _rows(paging.numbered_page(df, (), P.PAGE_OFFSET, P.PAGE_LIMIT))),
        "number_filter": L(lambda df: _rows(grid_filter(df, *P.NUMBER_CONDITIONS))),
        "level_summary": L(lambda df: rollup.level_summary(df, 1)),
        "gross_total": L(lambda df: rollup.level_summary(df, 0)),
        "rollup_report": L(lambda df: rollup.rollup_table(df)),
        "group_lookup": L(lambda df: rollup.group_lookup(df, {"entity_type": P.TYPE, "entity_sub_type": P.SUB_TYPE})),
        "group_lookup_missing": L(lambda df: rollup.group_lookup(df, {"entity_name": P.MISSING})),
        "profile": L(lambda df: totals.profile(df)),
        "filter_options": L(lambda df: totals.filter_options(df)),
        "flat_hierarchy": L(lambda df: rollup.flat_hierarchy(df)),
        "flat_hierarchy_nested": L(
            lambda df: rollup.flat_hierarchy_nested(df, chunk_rows=P.NESTED_CHUNK_ROWS).withColumn(
                "transactions", F.to_json("transactions")
            )
        ),
        "node_table": L(lambda df: tree.node_table(df)),
        "browse_start_level": L(lambda df: tree.browse(df, {"date": P.BUSY_DAY})),
        "browse_by_type": L(lambda df: tree.browse(df, {"entity_type": P.BROWSE_TYPE})),
        "expand_node": L(lambda df: tree.children(df, P.EXPAND_PATH)),
        "transactions_of": L(lambda df: tree.transactions(df, {"entity_name": P.NAME})),
        "leaf_cap": L(lambda df: tree.leaf_cap(df, P.LEAF_CAP)),
        "leaf_overflow": L(lambda df: tree.leaf_overflow(df, P.LEAF_CAP)),
        "leaf_cap_coarse": L(lambda df: tree.leaf_cap(df, P.COARSE_CAP, levels=P.COARSE_LEVELS)),
        "leaf_overflow_coarse": L(lambda df: tree.leaf_overflow(df, P.COARSE_CAP, levels=P.COARSE_LEVELS)),
        "leaf_cap_large": L(lambda df: tree.leaf_cap(df, P.LARGE_CAP, levels=P.LARGE_LEVELS)),
        "hierarchy": L(lambda df: tree.hierarchy(df, max_transactions=P.LEAF_CAP)),
        "sorted_ledger": L(lambda df: _rows(paging.sort_rows(df))),
        "user_sort": L(lambda df: _rows(paging.page(df, P.USER_SORT, 0, P.USER_SORT_LIMIT))),
        "data_page": L(lambda df: _rows(paging.page(df, (), P.PAGE_OFFSET, P.PAGE_LIMIT))),
        "page_meta": L(lambda df: paging.page_meta(df, P.PAGE_OFFSET, P.PAGE_LIMIT)),
        "seek_page": L(lambda df: _rows(paging.seek_page(df, P.SEEK_AFTER, (), P.SEEK_LIMIT))),
        "page_json": _page_json,
        "export_report": L(lambda df: reports.export_report(df, {"date": P.DAY})),
        "monthly_reconciliation": L(lambda df: reports.monthly_reconciliation(df)),
        "entity_rollup": L(lambda df: reports.entity_rollup(df)),
        "cash_vs_bank": L(lambda df: reports.cash_vs_bank(df)),
        "date_range": L(lambda df: reports.date_range(df, P.RANGE_START, P.RANGE_END)),
        "range_totals": L(lambda df: reports.range_totals(df, P.RANGE_START, P.RANGE_END)),
        "audit_trail": L(lambda df: reports.audit_trail(df, P.NAME)),
        "format_inr": L(lambda df: df.select(*COLUMNS, *[format_inr(F.col(m)).alias(f"{m}_inr") for m in MEASURES])),
        "format_amount": L(
            lambda df: df.select(*COLUMNS, *[format_amount(F.col(m)).alias(f"{m}_text") for m in MEASURES])
        ),
        "normalize_date": _normalize_date,
        "normalize_text": _normalize_text,
        "normalize_numeric": _normalize_numeric,
        "normalize_ledger": lambda s, d: _rows(_dirty_clean(s, d)),
        "drop_zero_rows": lambda s, d: _rows(_dirty_clean(s, d, drop_zero_rows=True)),
        "ingest_ledger": lambda s, d: totals.profile(_dirty_clean(s, d, with_rejects=True)),
        "generate_ledger": _generate,
        "ingest_rejects": _ingest_rejects,
        "ingest_checked": lambda s, d: _rows(normalize(_checked(s, d)[0])),
        "rollup_incremental": _rollup_incremental,
        "indexed_page": _indexed_page,
        "nested_tree": L(lambda df: nested.nested_tree(df, max_nodes=P.TREE_NODES)),
    }
    return q


# Queries checked by row count only (none: nested transactions are compared
# as their JSON text).
WEAK: set[str] = set()

FLAGSHIP = "entity_rollup"
