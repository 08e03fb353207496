"""Drill-down tree (H1-H9) as flat node tables.

The tree is never materialised as one nested object: the full tree is a
node table (one ``rollup``), browsing returns one level, expanding a node
filters on its path and groups the next level, and transaction leaves are
row projections. Node ids are paths ``/0/<date>/1/<type>/2/<sub>/3/<name>``;
transactions add ``/tx/<n>``, overflow rows ``/more``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.aggregates import group_measures
from ledgerlake.functions.predicates import LedgerFilter, path_filter
from ledgerlake.operators.filters import apply_filter
from ledgerlake.operators.ordinal import first_in_groups, number_rows, slices
from ledgerlake.operators.rollup import (
    NODE_MEASURES,
    groups_of_slices,
    level_label_sql,
    level_value_sql,
    node_path,
    node_path_sql,
    rollup_of_groups,
    rollup_table,
)
from ledgerlake.schema import COLUMNS, DIMS, ROW_ORDER

NODE_COLUMNS = [
    "node_id",
    "parent_id",
    "node_type",
    "level",
    "column",
    "label",
    *DIMS,
    *NODE_MEASURES,
    "has_children",
    "is_leaf",
]


def _group_nodes(agg: DataFrame, level: int | str) -> DataFrame:
    """Node columns from an aggregate carrying the dims (and ``level`` when
    it is a column name). Built as SQL text: one ``selectExpr``."""
    lvl = str(level)
    if isinstance(level, int):
        dims = [f"`{d}`" if i <= level else f"CAST(NULL AS STRING) AS `{d}`" for i, d in enumerate(DIMS)]
        parent = node_path_sql(level - 1)
    else:
        dims = [f"CASE WHEN {lvl} >= {i} THEN `{d}` END AS `{d}`" for i, d in enumerate(DIMS)]
        parent = f"CASE WHEN {lvl} > 0 THEN {node_path_sql(lvl + ' - 1')} END"
    return agg.selectExpr(
        f"{node_path_sql(level)} AS node_id",
        f"{parent} AS parent_id",
        "'group' AS node_type",
        f"CAST({lvl} AS INT) AS level",
        f"{level_label_sql(level)} AS `column`",
        f"{level_value_sql(level)} AS label",
        *dims,
        *NODE_MEASURES,
        # A group exists only if it has rows, so it always has children.
        "true AS has_children",
        "false AS is_leaf",
    )


def node_table(df: DataFrame, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """Every group node of levels 0-3 with count and sums: one rollup.

    Sort by ``txn_date, entity_type, entity_sub_type, entity_name`` (nulls
    first) for pre-order with siblings by label.
    """
    r = rollup_table(df, spec).filter(F.col("level") >= 0)
    return _group_nodes(r, "level")


def _level_nodes(df: DataFrame, f: LedgerFilter, level: int) -> DataFrame:
    """Nodes of ``level`` below the (fully set) prefix of ``f``."""
    agg = group_measures(apply_filter(df, f), DIMS[: level + 1])
    return _group_nodes(agg, level)


def browse(
    df: DataFrame, spec: LedgerFilter | Mapping | None = None, max_transactions: int | None = None
) -> DataFrame:
    """Nodes of the first level the spec leaves unset, over filtered rows.

    With all four levels set, the transaction leaves are returned: all of
    them, or with ``max_transactions`` so many and an overflow row.
    """
    f = LedgerFilter.of(spec)
    start = f.start_level()
    if start >= len(DIMS):
        return leaf_nodes(df, max_transactions, f)
    return _level_nodes(df, f, start)


def children(df: DataFrame, path: Sequence[str], max_transactions: int | None = None) -> DataFrame:
    """Expand the node at ``path`` (values from level 0 down): its child
    groups, or its transactions when ``path`` has all four levels (all, or
    with ``max_transactions`` so many and an overflow row)."""
    f = path_filter(tuple(path))
    if len(path) >= len(DIMS):
        return leaf_nodes(df, max_transactions, f)
    return _level_nodes(df, f, len(path))


def _tx_columns(levels: Sequence[str], index: Column) -> list[Column]:
    levels = list(levels)
    parent = node_path(len(levels) - 1, levels)
    return [
        F.concat(parent, F.lit("/tx/"), index.cast("string")).alias("node_id"),
        parent.alias("parent_id"),
        F.lit("transaction").alias("node_type"),
        F.lit(len(levels)).alias("level"),
        index.cast("bigint").alias("tx_index"),
        *[F.col(c) for c in COLUMNS],
    ]


def transactions(
    df: DataFrame,
    spec: LedgerFilter | Mapping | None = None,
    levels: Sequence[str] = DIMS,
    order_by: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    """Transaction leaves (level 4) of the filtered rows, numbered from 0
    inside their leaf group in ``order_by`` order. A leaf of any size is
    spread over range partitions."""
    levels = list(levels)
    rows = apply_filter(df, spec).select(*COLUMNS)
    numbered = number_rows(rows, levels, [F.col(c).asc_nulls_first() for c in order_by], "_n")
    return numbered.select(*_tx_columns(levels, F.col("_n")))


def capped_rows(
    df: DataFrame,
    cap: int,
    spec: LedgerFilter | Mapping | None = None,
    levels: Sequence[str] = DIMS,
    order_by: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    """The first ``cap`` rows of every leaf group, with ``_n`` (0-based),
    by ``ordinal.first_in_groups``."""
    levels = list(levels)
    rows = apply_filter(df, spec).select(*COLUMNS)
    return first_in_groups(rows, levels, list(order_by), cap)


def leaf_cap(
    df: DataFrame,
    cap: int,
    spec: LedgerFilter | Mapping | None = None,
    levels: Sequence[str] = DIMS,
    order_by: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    """Transaction leaves, at most ``cap`` per leaf group (rule C16)."""
    levels = list(levels)
    kept = capped_rows(df, cap, spec, levels, order_by)
    return kept.select(*_tx_columns(levels, F.col("_n")))


def leaf_overflow(
    df: DataFrame, cap: int, spec: LedgerFilter | Mapping | None = None, levels: Sequence[str] = DIMS
) -> DataFrame:
    """One ``info`` row per leaf group with more than ``cap`` rows:
    ``... and N more transactions`` (count from a partial aggregate)."""
    levels = list(levels)
    return _overflow_rows(apply_filter(df, spec).groupBy(*levels).agg(F.count(F.lit(1)).alias("_c")), cap, levels)


def _overflow_rows(counts: DataFrame, cap: int, levels: list[str]) -> DataFrame:
    parent = node_path(len(levels) - 1, levels)
    more = F.col("_c") - F.lit(cap)
    return counts.filter(more > 0).select(
        F.concat(parent, F.lit("/more")).alias("node_id"),
        parent.alias("parent_id"),
        F.lit("info").alias("node_type"),
        F.lit(len(levels)).alias("level"),
        *levels,
        # Fixed value: the label's wording.
        F.format_string("... and %d more transactions", more).alias("label"),
        more.cast("bigint").alias("remaining"),
    )


def leaf_nodes(
    df: DataFrame,
    cap: int | None,
    spec: LedgerFilter | Mapping | None = None,
    levels: Sequence[str] = DIMS,
    order_by: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    """Transactions (all of them without a ``cap``) plus overflow rows, one
    schema."""
    if cap is None:
        tx = transactions(df, spec, levels, order_by).withColumn("label", F.lit(None).cast("string"))
        return tx.withColumn("remaining", F.lit(None).cast("bigint"))
    tx = leaf_cap(df, cap, spec, levels, order_by).withColumn("label", F.lit(None).cast("string"))
    tx = tx.withColumn("remaining", F.lit(None).cast("bigint"))
    info = leaf_overflow(df, cap, spec, levels)
    return tx.unionByName(info, allowMissingColumns=True)


HIERARCHY_COLUMNS = [
    "node_id",
    "parent_id",
    "node_type",
    "level",
    "column",
    "label",
    *COLUMNS[:6],
    "row_count",
    *COLUMNS[6:],
    "gross_total",
    "has_children",
    "is_leaf",
    "tx_index",
    "remaining",
]


def hierarchy(
    df: DataFrame, spec: LedgerFilter | Mapping | None = None, max_transactions: int | None = None
) -> DataFrame:
    """The whole drill-down tree as one flat node table: group nodes of
    levels 0-3 (count, sums, gross) and the transactions under each leaf;
    with ``max_transactions`` so many of them and one ``info`` row per leaf
    that has more. The same filter applies to every part. Runs jobs: the rows
    are stored in range slices."""
    rows = apply_filter(df, spec).select(*COLUMNS)
    order = [F.col(c).asc_nulls_first() for c in ROW_ORDER]
    # Groups, leaves and what they leave out come from the same stored slices.
    stored = slices(rows, DIMS, order)
    state = groups_of_slices(stored)
    groups = _group_nodes(rollup_of_groups(state).filter(F.col("level") >= 0), "level")
    numbered = stored.numbered(stored.rows, order, "_n")
    if max_transactions is not None:
        numbered = numbered.filter(F.col("_n") < max_transactions)
    leaves = numbered.select(*_tx_columns(DIMS, F.col("_n")))
    if max_transactions is not None:
        more = _overflow_rows(state.select(*DIMS, F.col("__rows").alias("_c")), max_transactions, DIMS)
        leaves = leaves.unionByName(more, allowMissingColumns=True)
    else:
        leaves = leaves.withColumns({"label": F.lit(None).cast("string"), "remaining": F.lit(None).cast("bigint")})
    leaves = leaves.withColumn("has_children", F.lit(False)).withColumn("is_leaf", F.lit(True))
    return groups.unionByName(leaves, allowMissingColumns=True).select(*HIERARCHY_COLUMNS)
