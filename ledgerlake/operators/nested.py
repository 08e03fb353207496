"""The whole drill-down tree as nested JSON, in bounded pieces (H2).

The tree is one JSON document: date, type, sub type and name groups with
their count and sums, and the transactions below. One document of a whole
ledger would outgrow any row, so it is written in pieces of about
``max_nodes`` nodes. Pieces are built from the bottom up: the children of a
node are listed in order, and a running sum of their sizes cuts the list
into parts. A node with at most ``max_nodes`` below it holds its children; a
larger one holds none, says in ``parts`` how many rows continue it, and
counts as a single node above. So a hot date is several rows, whatever its
size, and a small one stands whole inside its parent.

Each result row is a part: ``path`` (id of the node that it continues, empty
for the top), ``part``, ``nodes`` and ``json``, an array of child nodes. The
parts of one path, in order, are all children of that node; put in the place
of its ``children`` they give the whole document (``parts`` 0: they are there).

Every transaction is kept. The rows are ranged by group and order and stored
once (``ordinal.stored_ranges``). As the children of a group above the full
groups follow each other in that order, its list and those of its full groups
are made where they lie, by windows over one sort and a single aggregate;
only the groups on several slices are shuffled, so no group has to fit a
task. Their offsets come from a count of the full groups. What is collected
into one row is bounded by twice ``max_nodes``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions.aggregates import unit_columns, units_text_sql, wide_carried, wide_columns, wide_names, wide_sum_text_sql, wide_units_sql
from ledgerlake.functions.predicates import LedgerFilter
from ledgerlake.operators.filters import apply_filter
from ledgerlake.operators.ordinal import MAX_BROADCAST, SLICE, null_safe_join, number_rows, stored_ranges
from ledgerlake.operators.rollup import node_path, node_path_sql, rollup_above
from ledgerlake.schema import COLUMNS, DIMS, DISPLAY_NAMES, MEASURES
from ledgerlake.session import shared_dir

MAX_NODES = 5000
_TOP = "_top"
# Levels above the full groups, and the level of the full groups.
_ABOVE, _NAME = DIMS[:-1], DIMS[-1]
# What JSON writes otherwise than it stands.
_ESCAPED = r'["\\\x00-\x1f\ufffd]'


def _amounts() -> Column:
    return F.struct(*[F.col(m).cast("decimal(38,4)").alias(m) for m in MEASURES])


def _open_object(fields: Column) -> Column:
    """The JSON text of a struct without its closing brace."""
    text = F.to_json(fields, {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _parts(children: DataFrame, parents: list[str], order: list[Column], max_nodes: int, path: str) -> DataFrame:
    """``children`` (``parents``, ``size``, ``json``) packed in order: a
    row for each parent and part."""
    placed = number_rows(children, parents, order, "_before", weight="size")
    part = F.floor(F.col("_before") / max_nodes).cast("long")
    item = F.struct("_before", "json")
    packed = placed.groupBy(*parents, part.alias("part")).agg(F.sum("size").alias("nodes"), F.array_sort(F.collect_list(item)).alias("items"))
    packed.select(*parents, "part", "nodes", _array(F.transform("items", lambda x: x["json"])).alias("json")).write.parquet(path)
    return children.sparkSession.read.parquet(path)


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _ascending(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def _size(below: Column, max_nodes: int) -> Column:
    """Nodes of a group where it stands in its parent's list."""
    return F.when(below <= max_nodes, below + 1).otherwise(1).cast("long")


def _part(before: Column, max_nodes: int) -> Column:
    return F.floor(before / max_nodes).cast("long")


def _group_node(level: int, max_nodes: int, first: Column) -> list[Column]:
    """``size`` and ``json`` of a group node from its facts, ``parts`` and
    ``below``; ``first`` is the text of its children."""
    whole = F.col("below") <= max_nodes
    head = F.struct(
        node_path(level).alias("id"), F.lit("group").alias("type"), F.lit(level).alias("level"), F.col(DIMS[level]).alias("label"),
        F.lit(DISPLAY_NAMES[DIMS[level]]).alias("column"), F.col("row_count").alias("count"), _amounts().alias("aggregates"), F.when(whole, 0).otherwise(F.col("parts")).alias("parts"),
    )
    inside = F.when(whole, first).otherwise(F.lit("[]"))
    return [_size(F.col("below"), max_nodes).alias("size"), F.concat(_open_object(head), F.lit(',"children":'), inside, F.lit("}")).alias("json")]


def _names(stored: DataFrame, max_nodes: int, path: str) -> DataFrame:
    """The groups above the full groups, slice by slice: ``_size`` of their
    full groups, counted as if each ended there, and the ``_first`` and
    ``_last`` of them (name and rows)."""
    counted = stored.groupBy(SLICE, *DIMS).agg(F.count(F.lit(1)).alias("_rows"))
    end = F.struct(F.col(_NAME).alias("name"), "_rows")
    sums = [F.sum(_size(F.col("_rows"), max_nodes)).alias("_size"), F.min(end).alias("_first"), F.max(end).alias("_last")]
    counted.groupBy(SLICE, *_ABOVE).agg(*sums).write.parquet(path)
    return stored.sparkSession.read.parquet(path)


def _cut(stored: DataFrame, place: Column, max_nodes: int, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where groups are that span slices: ``known`` has ``below`` and
    ``parts`` of every group above the full groups; ``names`` the slices of
    the full groups on several, with the rows before (``_start``), in all
    (``_total``) and their limb sums; ``above`` those of the groups above
    them, with the size before (``_first``) and in all (``_below``). The last
    two have at most two rows for each slice."""
    spark = stored.sparkSession
    found = _names(stored, max_nodes, f"{base}/names")
    several = null_safe_join(found, found.groupBy(*_ABOVE).count().where("count > 1").drop("count"), _ABOVE, "left_semi")
    ends = several.select(SLICE, *_ABOVE, F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_end"))
    ends = ends.select(SLICE, *_ABOVE, F.col("_end.name").alias(_NAME), F.col("_end._rows").alias("_rows"))
    own = Window.partitionBy(*DIMS)
    before = F.sum("_rows").over(own.orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    placed = ends.withColumns({"_pieces": F.count(F.lit(1)).over(own), "_total": F.sum("_rows").over(own), "_start": F.coalesce(before, F.lit(0))})
    placed.where("_pieces > 1").drop("_pieces").write.parquet(f"{base}/pieces")
    pieces = spark.read.parquet(f"{base}/pieces")

    # What was counted where a full group ends too early, and where it starts.
    starts = F.when(F.col("_start") == 0, _size(F.col("_total"), max_nodes)).otherwise(0)
    more = pieces.groupBy(SLICE, *_ABOVE).agg(F.sum(starts - _size(F.col("_rows"), max_nodes)).alias("_more"))
    sized = null_safe_join(found, F.broadcast(more), [SLICE, *_ABOVE], "left").withColumn("_size", F.col("_size") + F.coalesce("_more", F.lit(0)))
    groups = sized.groupBy(*_ABOVE).agg(F.sum("_size").alias("below"), F.max("_last").alias("_last"), F.count(F.lit(1)).alias("_slices"))
    groups = groups.select(*_ABOVE, F.col("_last.name").alias(_NAME), "below", F.col("_last._rows").alias("_rows"), "_slices")
    totals = pieces.where("_start = 0").select(*DIMS, "_total")
    last = _size(F.coalesce("_total", "_rows"), max_nodes)
    known = null_safe_join(groups, F.broadcast(totals), DIMS, "left")
    known.select(*_ABOVE, "below", (_part(F.col("below") - last, max_nodes) + 1).alias("parts"), "_slices").write.parquet(f"{base}/known")

    parents = Window.partitionBy(*_ABOVE)
    before = F.sum("_size").over(parents.orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    above = null_safe_join(sized, several.select(*_ABOVE).distinct(), _ABOVE, "left_semi")
    above = above.select(SLICE, *_ABOVE, F.coalesce(before, F.lit(0)).alias("_first"), F.sum("_size").over(parents).alias("_below"))
    above.write.parquet(f"{base}/above")

    rows = null_safe_join(stored, F.broadcast(totals.select(*DIMS)), DIMS, "left_semi").select(SLICE, *DIMS, *MEASURES, *unit_columns())
    added, types = [F.sum(name).alias(name) for name in wide_names()], ["bigint", "bigint", "decimal(38,4)"] * len(MEASURES)
    sums = rows.select(SLICE, *DIMS, *wide_columns()).groupBy(SLICE, *DIMS).agg(*added).select(*DIMS, *wide_carried()).groupBy(*DIMS)
    sums = sums.agg(*[F.sum(name).cast(kind).alias(name) for name, kind in zip(wide_names(), types)])
    null_safe_join(pieces.drop("_rows"), sums, DIMS, "inner").write.parquet(f"{base}/sums")
    return tuple(spark.read.parquet(f"{base}/{name}") for name in ("known", "sums", "above"))


def _numbered(rows: DataFrame, max_nodes: int, names: DataFrame | None, above: DataFrame | None) -> DataFrame:
    """``rows`` with their position (``_n``) in the full group, its
    ``_total`` and the text of its sums, its position (``_before``) in the
    group above, and that one's ``below``. Both windows follow one sort.
    ``names`` and ``above`` (of ``_cut``) are needed for groups that span
    slices."""
    wide, everything = wide_names(), (Window.unboundedPreceding, Window.unboundedFollowing)
    own = Window.partitionBy(SLICE, *DIMS).orderBy(*_ascending(COLUMNS[len(DIMS) :]))
    kept = [SLICE, *COLUMNS, *[f"__units_{m}" for m in MEASURES]]
    # Sorted here, for both windows, before the columns that are added up.
    made = rows.select(SLICE, *COLUMNS).sortWithinPartitions(*_ascending([SLICE, *COLUMNS]))
    made = made.select(SLICE, *COLUMNS, *unit_columns()).select(*kept, *wide_columns())
    sums = [F.sum(name).over(own.rowsBetween(*everything)).alias(name) for name in wide]
    made = made.select(*kept, (F.row_number().over(own) - 1).cast("long").alias("_n"), F.count(F.lit(1)).over(own.rowsBetween(*everything)).alias("_total"), *sums)
    if names is not None:
        there = names.select(SLICE, *DIMS, "_start", F.col("_total").alias("_all"), *[F.col(name).alias(f"_all{name}") for name in wide])
        joined = null_safe_join(made, F.broadcast(there), [SLICE, *DIMS], "left")
        over = [F.when(F.col("_all").isNotNull(), F.col(f"_all{name}")).otherwise(F.col(name)).alias(name) for name in wide]
        made = joined.select(*kept, (F.col("_n") + F.coalesce("_start", F.lit(0))).alias("_n"), F.coalesce("_all", "_total").alias("_total"), *over)
    made = made.select(*kept, "_n", "_total", *wide, *[F.expr(wide_units_sql(m)).alias(f"_s_{m}") for m in MEASURES])
    texts = [f"""'{"," if i else ""}"{m}":', {wide_sum_text_sql(m, f"_s_{m}")}""" for i, m in enumerate(MEASURES)]
    made = made.select(*kept, "_n", "_total", F.expr(f"CASE WHEN _n = 0 THEN concat({', '.join(texts)}) END").alias("_sums"))

    size = _size(F.col("_total"), max_nodes)
    listed = Window.partitionBy(SLICE, *_ABOVE).orderBy(*_ascending(COLUMNS[len(_ABOVE) :]))
    until = F.sum(F.when(F.col("_n") == 0, size).otherwise(0))
    made = made.select("*", (until.over(listed.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("_before"), until.over(listed.rowsBetween(*everything)).alias("below"))
    if above is not None:
        joined = null_safe_join(made, F.broadcast(above), [SLICE, *_ABOVE], "left")
        made = joined.withColumns({"_before": F.col("_before") + F.coalesce("_first", F.lit(0)), "below": F.coalesce("_below", "below")})
    return made


def _transaction() -> str:
    """SQL text of a transaction's JSON. Names that need no escape are put
    together as they stand."""
    level = len(DIMS)
    path = f"concat({node_path_sql(level - 1)}, '/tx/', CAST(_n AS STRING))"
    plain = f"""concat('{{"id":"', {path}, '","type":"transaction","level":{level},"vch_type":"', `vch_type`, '","particulars":"', `particulars`, '"')"""
    other = f"to_json(named_struct('id', {path}, 'type', 'transaction', 'level', {level}, 'vch_type', `vch_type`, 'particulars', `particulars`), map('ignoreNullFields', 'false'))"
    amounts = [f"""'{"," if i else ""}"{m}":', coalesce({units_text_sql(f"__units_{m}")}, CAST(CAST(`{m}` AS DECIMAL(38,4)) AS STRING), 'null')""" for i, m in enumerate(MEASURES)]
    return f"""concat(CASE WHEN _plain THEN {plain} ELSE substring({other}, 1, length({other}) - 1) END, ',"amounts":{{', {", ".join(amounts)}, '}}}}')"""


def _name_head(max_nodes: int) -> str:
    """SQL text of a full group's JSON up to its children."""
    level = len(DIMS) - 1
    path, column = node_path_sql(level), DISPLAY_NAMES[_NAME]
    plain = f"""concat('{{"id":"', {path}, '","type":"group","level":{level},"label":"', `{_NAME}`, '","column":"{column}"')"""
    other = f"to_json(named_struct('id', {path}, 'type', 'group', 'level', {level}, 'label', `{_NAME}`, 'column', '{column}'), map('ignoreNullFields', 'false'))"
    parts = f"CASE WHEN _total <= {max_nodes} THEN 0 ELSE (_total - 1) DIV {max_nodes} + 1 END"
    facts = f"""',"count":', CAST(_total AS STRING), ',"aggregates":{{', _sums, '}},"parts":', CAST({parts} AS STRING), ',"children":['"""
    return f"""concat(CASE WHEN _plain THEN {plain} ELSE substring({other}, 1, length({other}) - 1) END, {facts})"""


def _lists(rows: DataFrame, max_nodes: int, wanted: Column, names: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """The parts of the lists in and above the full groups: ``_leaf``, the
    levels, ``part``, ``nodes``, ``below`` and ``json``; only those that are
    ``wanted``. Without ``names`` and ``above`` no group spans slices, and no
    row is shuffled."""
    numbered = _numbered(rows, max_nodes, names, above)
    # Null where a level is: such names are not plain either.
    numbered = numbered.withColumn("_plain", ~F.concat(*[F.col(c) for c in COLUMNS[: -len(MEASURES)]]).rlike(_ESCAPED))
    small, first = F.col("_total") <= max_nodes, F.col("_n") == 0
    numbered = numbered.select(
        SLICE, *DIMS, "_before", "_n", "_total", "below", _part(F.col("_before"), max_nodes).alias("_place"),
        F.when(first, F.expr(_name_head(max_nodes))).alias("_head"), F.expr(_transaction()).alias("_text"),
    )
    # A row of its full group's list where that is continued, else of the
    # one above; there the first row of a continued group is its node.
    text = F.concat(F.when(small & first, F.col("_head")).otherwise(""), F.col("_text"), F.when(small & (F.col("_n") == F.col("_total") - 1), "]}").otherwise(""))
    own = F.struct(
        (~small).alias("_leaf"), F.when(~small, F.col(_NAME)).alias("_name"), F.when(small, F.col("_place")).otherwise(_part(F.col("_n"), max_nodes)).alias("part"),
        F.when(~small, 1).when(first, F.col("_total") + 1).otherwise(0).cast("long").alias("size"), text.alias("text"),
    )
    node = F.struct(F.lit(False).alias("_leaf"), F.lit(None).cast("string").alias("_name"), F.col("_place").alias("part"), F.lit(1).cast("long").alias("size"), F.concat("_head", F.lit("]}")).alias("text"))
    entries = numbered.select(SLICE, *_ABOVE, "_before", "_n", "below", F.explode(F.array(own, F.when(~small & first, node))).alias("_e")).where(F.col("_e").isNotNull())
    entries = entries.select(SLICE, *_ABOVE, "_before", "_n", "below", "_e.*").where(wanted)
    grouped = entries.groupBy(*([SLICE] if names is None else []), *_ABOVE, "_leaf", "_name", "part")
    made = grouped.agg(F.sum("size").alias("nodes"), F.max("below").alias("below"), F.array_sort(F.collect_list(F.struct("_before", "_n", "text"))).alias("items"))
    return made.select("_leaf", *_ABOVE, F.col("_name").alias(_NAME), "part", "nodes", "below", _array(F.transform("items", lambda x: x["text"])).alias("json"))


def _leaf_lists(stored: DataFrame, place: Column, max_nodes: int, base: str) -> tuple[DataFrame, DataFrame]:
    """``parts``, ``below`` and, where they stand in it, the children
    (``first``) of every group above the full groups; and the parts of the
    lists of those and of the full groups that are continued."""
    known, names, above = _cut(stored, place, max_nodes, base)
    spans = F.broadcast(known.where("_slices > 1").select(*_ABOVE))

    def lists(rows: DataFrame, wanted: Column) -> DataFrame:
        whole = _lists(null_safe_join(rows, spans, _ABOVE, "left_anti"), max_nodes, wanted)
        return whole.unionByName(_lists(null_safe_join(rows, spans, _ABOVE, "left_semi"), max_nodes, wanted, names, above))

    inside = known.where(F.col("below") <= max_nodes).select(*_ABOVE)
    if count := inside.count():
        rows = stored if count > MAX_BROADCAST else null_safe_join(stored, F.broadcast(inside), _ABOVE, "left_semi")
        firsts = lists(rows, ~F.col("_leaf") & (F.col("below") <= max_nodes)).select(*_ABOVE, F.col("json").alias("first"))
    else:
        firsts = known.limit(0).select(*_ABOVE, F.lit("").alias("first"))
    continued = lists(stored, F.col("_leaf") | (F.col("below") > max_nodes))
    path = F.when(F.col("_leaf"), node_path(len(DIMS) - 1)).otherwise(node_path(len(DIMS) - 2))
    return known.drop("_slices").unionByName(firsts, allowMissingColumns=True), continued.select(path.alias("path"), "part", "nodes", "json")


def nested_tree(df: DataFrame, spec: LedgerFilter | Mapping | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """The parts of the nested tree of the filtered rows: ``path``,
    ``part``, ``nodes``, ``json``. Runs jobs, and keeps the pieces of every
    level under ``spark.checkpoint.dir``."""
    spark, base = df.sparkSession, shared_dir(df.sparkSession, f"nested-{uuid.uuid4().hex}")
    rows = apply_filter(df, spec).select(*COLUMNS)
    stored, place, _ = stored_ranges(rows, DIMS, _ascending(COLUMNS), COLUMNS)
    rollup_above(stored).where("level >= 0").write.parquet(f"{base}/groups")
    groups = spark.read.parquet(f"{base}/groups")

    known, continued = _leaf_lists(stored, place, max_nodes, base)
    out = [continued]
    for level in range(len(DIMS) - 2, -1, -1):
        parents = DIMS[: level + 1]
        if level < len(DIMS) - 2:
            packed = _parts(children, parents, order, max_nodes, f"{base}/level-{level}")
            first = F.when(F.col("part") == 0, F.col("json"))
            known = packed.groupBy(*parents).agg(
                (F.max("part") + 1).alias("parts"), F.sum("nodes").alias("below"), F.max(first).alias("first"), F.max(F.when(F.col("part") == 0, F.col("nodes"))).alias("nodes")
            )
            continued = packed.where("part > 0").unionByName(
                known.where(F.col("below") > max_nodes).select(*parents, F.lit(0).cast("long").alias("part"), "nodes", F.col("first").alias("json"))
            )
            out.append(continued.select(node_path(level).alias("path"), "part", "nodes", "json"))
            known = known.drop("nodes")
        # Facts and children of a group meet in an aggregate.
        facts = groups.where(F.col("level") == level).select(*parents, "row_count", *MEASURES)
        merged = facts.unionByName(known, allowMissingColumns=True).groupBy(*parents)
        nodes = merged.agg(*[F.max(c).alias(c) for c in ("row_count", *MEASURES, "parts", "below", "first")])
        # Stored: what follows is dealt by their own size, not the ledger's.
        nodes.select(*parents, *_group_node(level, max_nodes, F.col("first"))).write.parquet(f"{base}/nodes-{level}")
        children = spark.read.parquet(f"{base}/nodes-{level}")
        order = [F.col(parents[-1]).asc_nulls_first()]
    top = _parts(children.withColumn(_TOP, F.lit("")), [_TOP], order, max_nodes, f"{base}/top")
    out.append(top.select(F.lit("").alias("path"), "part", "nodes", "json"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
