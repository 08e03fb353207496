"""Level aggregates and the rollup behind drill-down.

The four prefix group-bys of the hierarchy are one ``rollup`` (one
``Expand`` + one partial/final hash aggregate), not four scans. Filters
are applied before the rollup so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions.aggregates import finish_measures, group_measures, limb_columns, limb_fields, totals_of
from ledgerlake.functions.predicates import LedgerFilter
from ledgerlake.operators.filters import apply_filter
from ledgerlake.schema import COLUMNS, DIMS, DISPLAY_NAMES, MEASURES

NODE_MEASURES = ["row_count", *MEASURES, "gross_total"]


def node_path_sql(level: int | str, dims: Sequence[str] = DIMS) -> str:
    """SQL text of the path id ``/0/<date>/1/<type>/...`` down to ``level``
    (an int, or the name of an int column).

    Relations between nodes use the dim columns, never a split of this
    string, since values may contain ``/``.
    """
    if isinstance(level, int):
        if level < 0:
            return "CAST(NULL AS STRING)"
        return "concat(" + ", ".join(f"'/{i}/', `{d}`" for i, d in enumerate(dims[: level + 1])) + ")"
    parts = [f"CASE WHEN {level} >= {i} THEN concat('/{i}/', `{d}`) ELSE '' END" for i, d in enumerate(dims)]
    return "concat(" + ", ".join(parts) + ")"


def node_path(level: int | str, dims: Sequence[str] = DIMS) -> Column:
    return F.expr(node_path_sql(level, dims))


def level_value_sql(level: int | str, dims: Sequence[str] = DIMS) -> str:
    """The value of the node's own level (its label)."""
    if isinstance(level, int):
        return f"`{dims[level]}`"
    return "CASE " + " ".join(f"WHEN {level} = {i} THEN `{d}`" for i, d in enumerate(dims)) + " END"


def level_label_sql(level: int | str, dims: Sequence[str] = DIMS) -> str:
    """Display name of the node's level column."""
    if isinstance(level, int):
        return f"'{DISPLAY_NAMES.get(dims[level], dims[level])}'"
    whens = " ".join(f"WHEN {level} = {i} THEN '{DISPLAY_NAMES.get(d, d)}'" for i, d in enumerate(dims))
    return f"CASE {whens} END"


def level_summary(df: DataFrame, level: int, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """Group by one level: ``level, column, value`` + count, sums, gross."""
    dim = DIMS[level]
    return group_measures(apply_filter(df, spec), [dim]).select(
        F.lit(level).alias("level"),
        F.lit(DISPLAY_NAMES[dim]).alias("column"),
        F.col(dim).alias("value"),
        *NODE_MEASURES,
    )


def rollup_table(
    df: DataFrame, spec: LedgerFilter | Mapping | None = None, dims: Sequence[str] = DIMS
) -> DataFrame:
    """Every prefix of ``dims`` plus the grand total in one pass.

    ``level`` = index of the deepest set dim (``-1`` for the grand total),
    derived from ``grouping()`` so rollup nulls are never confused with
    data nulls.
    """
    dims = list(dims)
    grouped_out = sum((F.grouping(d).cast("int") for d in dims), F.lit(0))
    level = (F.lit(len(dims) - 1) - grouped_out).alias("level")
    # Limbs are projected once per row, below the Expand that copies each
    # row once per grouping set.
    r = group_measures(apply_filter(df, spec), dims, level, rollup=True)
    return r.select("level", *dims, *NODE_MEASURES)


def _levels_above(groups: DataFrame) -> DataFrame:
    """Every prefix of the levels above the full groups, and the grand total,
    as ``__rows`` and limb sums."""
    grouped_out = sum((F.grouping(d).cast("int") for d in DIMS[:-1]), F.lit(0))
    sums = [F.sum(name).cast(kind).alias(name) for name, kind in [("__rows", "bigint"), *limb_fields()]]
    return groups.rollup(*DIMS[:-1]).agg((F.lit(len(DIMS) - 2) - grouped_out).alias("level"), *sums)


def rollup_of_groups(groups: DataFrame) -> DataFrame:
    """The rows of ``rollup_table`` from one row for each full group
    (``__rows`` and the limb sums): only the levels above are added up."""
    above = _levels_above(groups)
    every = groups.withColumn("level", F.lit(len(DIMS) - 1)).unionByName(above.withColumn(DIMS[-1], F.lit(None).cast("string")))
    return finish_measures(every, F.col("__rows")).select("level", *DIMS, *NODE_MEASURES)


def rollup_above(rows: DataFrame) -> DataFrame:
    """The rows of ``rollup_table`` for the levels above the full groups."""
    pre = rows.select(*DIMS[:-1], *limb_columns()).groupBy(*DIMS[:-1])
    sums = [F.sum(name).cast(kind).alias(name) for name, kind in limb_fields()]
    above = _levels_above(pre.agg(F.count(F.lit(1)).alias("__rows"), *sums))
    return finish_measures(above, F.col("__rows")).select("level", *DIMS[:-1], *NODE_MEASURES)


def groups_of_slices(stored) -> DataFrame:
    """One row for each full group (levels, ``__rows`` and the limb sums) of
    ``ordinal.Slices`` by the levels; only the groups that span slices are
    shuffled, as sums."""

    def added(part: DataFrame, *keys: str) -> DataFrame:
        sums = [F.sum(name).cast(kind).alias(name) for name, kind in limb_fields()]
        grouped = part.select(*keys, *DIMS, *limb_columns()).groupBy(*keys, *DIMS)
        return grouped.agg(F.count(F.lit(1)).alias("__rows"), *sums).drop(*keys)

    return added(stored.whole(), "_slice").unionByName(added(stored.rest()))


def group_lookup(df: DataFrame, keys: Mapping[str, str | None]) -> DataFrame:
    """Aggregates of one group given by any subset of the levels.

    A group that does not exist gives zeros; no keys gives the grand total.
    ``level`` is the number of keys set.
    """
    f = LedgerFilter.of(keys)
    return totals_of(apply_filter(df, f)).select(F.lit(len(f.items())).alias("level"), *NODE_MEASURES)


def flat_hierarchy(df: DataFrame, spec: LedgerFilter | Mapping | None = None) -> DataFrame:
    """One row per full (date, type, sub type, name) group, ``id = a/b/c/d``."""
    return group_measures(apply_filter(df, spec), DIMS).select(
        F.concat_ws("/", *[F.col(d) for d in DIMS]).alias("id"),
        F.lit(3).alias("level"),
        *DIMS,
        *NODE_MEASURES,
    )


def flat_hierarchy_nested(
    df: DataFrame,
    spec: LedgerFilter | Mapping | None = None,
    chunk_rows: int = 1000,
) -> DataFrame:
    """Flat hierarchy with the group's transactions nested as an array.

    No row is dropped and no array grows with the data: rows are numbered
    inside their group over range partitions and cut into chunks of at most
    ``chunk_rows``. Output has one row per (group, ``chunk``), chunk 0
    first; the group totals repeat on every chunk.
    """
    from ledgerlake.operators.ordinal import SLICE, null_safe_join, slices

    rows = apply_filter(df, spec).select(*COLUMNS)
    order = [F.col(c).asc_nulls_first() for c in COLUMNS]
    stored = slices(rows, DIMS, order)
    tx = F.struct(F.col("_n").alias("tx_index"), *[F.col(c) for c in COLUMNS[4:]])
    limbs = [name for name, _ in limb_fields()]

    def chunks(part: DataFrame, *keys: str) -> DataFrame:
        numbered = stored.numbered(part, order, "_n").withColumn("chunk", F.floor(F.col("_n") / chunk_rows).cast("bigint"))
        made = numbered.select(*keys, *DIMS, "chunk", tx.alias("_tx"), *limb_columns()).groupBy(*keys, *DIMS, "chunk")
        sums = [F.sum(name).alias(name) for name in limbs]
        return made.agg(F.array_sort(F.collect_list("_tx")).alias("transactions"), F.count(F.lit(1)).alias("__rows"), *sums)

    # A group in one slice is added up there; the few others meet in a shuffle.
    group = Window.partitionBy(SLICE, *DIMS)
    whole = chunks(stored.whole(), SLICE).withColumns({name: F.sum(name).over(group) for name in ["__rows", *limbs]}).drop(SLICE)
    rest = chunks(stored.rest())
    sums = rest.groupBy(*DIMS).agg(*[F.sum(name).alias(name) for name in ["__rows", *limbs]])
    rest = null_safe_join(rest.drop("__rows", *limbs), F.broadcast(sums), DIMS, "inner")
    return finish_measures(whole.unionByName(rest), F.col("__rows")).select(
        F.concat_ws("/", *[F.col(d) for d in DIMS]).alias("id"), F.lit(3).alias("level"), *DIMS, *NODE_MEASURES, "chunk", "transactions"
    )


def write_rollup(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save ``rollup_table`` once (the reference's load-time aggregates), ranged
    and sorted by (level, dims) so lookups skip row groups by min/max."""
    r = rollup_table(df)
    keys = ["level", *DIMS]
    r.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def rollup_options(rollup: DataFrame) -> DataFrame:
    """``totals.filter_options`` answered from a saved rollup: the distinct
    values stand in its nodes, one row for each (level, path)."""
    return (
        rollup.where("level >= 0")
        .selectExpr(
            "CASE level " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIMS)) + " END AS dimension",
            f"{level_value_sql('level')} AS value",
        )
        .distinct()
        .orderBy("dimension", "value")
    )


def _prefix_filter(rollup: DataFrame, values: Sequence[str]) -> DataFrame:
    cond = F.col("level") == F.lit(len(values) - 1)
    for d, v in zip(DIMS, values):
        cond = cond & (F.col(d) == F.lit(str(v)))
    return rollup.filter(cond)


def rollup_lookup(rollup: DataFrame, keys: Mapping[str, str | None]) -> DataFrame:
    """``group_lookup`` answered from a saved rollup: the keys must be a
    prefix of the levels (date, then type, ...). A group that does not exist
    gives zeros; no keys gives the grand total. Same columns as
    ``group_lookup``."""
    f = LedgerFilter.of(keys)
    items = f.items()
    values = [v for _, v in items]
    if [c for c, _ in items] != DIMS[: len(items)]:
        raise ValueError("rollup_lookup needs a prefix of the levels; use group_lookup for other key sets")
    hit = _prefix_filter(rollup, values)
    sums = [F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in [*MEASURES, "gross_total"]]
    return hit.agg(
        F.lit(len(items)).alias("level"), F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("row_count"), *sums
    ).select("level", *NODE_MEASURES)


def rollup_children(rollup: DataFrame, path: Sequence[str]) -> DataFrame:
    """The child group nodes of ``path`` (fewer than four values) read from
    a saved rollup, in the same node shape as ``tree.children``."""
    from ledgerlake.operators.tree import _group_nodes

    if len(path) >= len(DIMS):
        raise ValueError("leaf transactions are not in the rollup; use tree.children on the ledger")
    level = len(path)
    cond = F.col("level") == F.lit(level)
    for d, v in zip(DIMS, path):
        cond = cond & (F.col(d) == F.lit(str(v)))
    return _group_nodes(rollup.filter(cond), level)
