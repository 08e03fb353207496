"""Sorting and paging.

Spark rows have no inherent order, so every page uses a *total* order: the
requested sort keys followed by all ledger columns as tie-breakers.
``page`` keeps ``offset + limit`` rows of each task and merges them, over
many splits in a tree of tasks (``top_rows``): right for the first pages. ``seek_page`` resumes at the last seen key and keeps
only ``limit`` rows of each task: right for walking on. ``numbered_page``
numbers all rows over range partitions and cuts any page out of them: right
for one far page, at the cost of a sort of everything. Which of them runs
is the caller's choice, not the data's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.aggregates import exact_sum
from ledgerlake.operators.ordinal import number_rows, partition_count
from ledgerlake.schema import DIMS, MEASURES, ROW_ORDER

#: Tasks whose first rows one task merges.
FAN_IN = 64


def _key(spec) -> tuple[str, bool]:
    if isinstance(spec, str):
        return spec, True
    name, direction = spec
    if direction not in ("asc", "desc"):
        raise ValueError(f"sort direction must be 'asc' or 'desc', got {direction!r}")
    return name, direction == "asc"


def total_order(order_by: Sequence = (), tie_break: Sequence[str] = ROW_ORDER) -> list[tuple[str, bool]]:
    """Requested keys, then the remaining tie-break columns ascending."""
    keys = [_key(s) for s in order_by]
    seen = {k for k, _ in keys}
    return keys + [(c, True) for c in tie_break if c not in seen]


def _sort_cols(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(k).asc_nulls_first() if asc else F.col(k).desc_nulls_last() for k, asc in keys]


def sort_rows(df: DataFrame, order_by: Sequence = tuple(DIMS)) -> DataFrame:
    """Globally sorted rows (range-partitioned sort, no single task)."""
    return df.orderBy(*_sort_cols(total_order(order_by)))


def _first_of_each_task(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every task, by their place in its sort."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.sortWithinPartitions(*order).withColumn("_place", place).where(F.col("_place") < k).drop("_place")


def top_rows(df: DataFrame, order: list[Column], k: int, fan_in: int = FAN_IN, parts: int | None = None) -> DataFrame:
    """Rows among which the first ``k`` in ``order`` are, in at most
    ``fan_in`` tasks of at most ``k`` rows each.

    A plain limit lets one task merge ``k`` rows of every split. Here every
    task keeps its first ``k``, and they are merged ``fan_in`` tasks at a
    time until so few are left: no merge sees more than ``fan_in * k`` rows,
    however many splits the input has (``parts``; by its size if not given).
    """
    n = partition_count(df, parts)
    if n <= fan_in:
        return df
    top = _first_of_each_task(df, order, k)
    while n > fan_in:
        n = -(-n // fan_in)
        # Rows are dealt evenly: any split of them keeps the first k in some task's k.
        top = _first_of_each_task(top.repartition(n), order, k)
    return top


def page(
    df: DataFrame, order_by: Sequence, offset: int, limit: int | None, fan_in: int = FAN_IN, parts: int | None = None
) -> DataFrame:
    """One page in total order. A falsy ``limit`` returns every row (sorted)
    and ignores ``offset``, as the reference does."""
    if not limit:
        return sort_rows(df, order_by)
    order = _sort_cols(total_order(order_by))
    sorted_df = top_rows(df, order, offset + limit, fan_in, parts).orderBy(*order)
    if offset:
        sorted_df = sorted_df.offset(offset)
    return sorted_df.limit(limit)


def numbered_page(df: DataFrame, order_by: Sequence, offset: int, limit: int) -> DataFrame:
    """The rows of ``page`` cut out of a numbering of all rows: no task
    holds more than its range partition, however deep the page."""
    numbered = number_rows(df, [], _sort_cols(total_order(order_by)), out="_row")
    window = numbered.filter((F.col("_row") >= offset) & (F.col("_row") < offset + limit))
    return window.orderBy("_row").drop("_row")


def page_meta(df: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """``total_count`` (before paging), ``returned``, ``page_offset`` and
    the four exact sums over all rows, in one pass."""
    n = F.count(F.lit(1))
    if limit:
        returned = F.least(F.lit(limit).cast("bigint"), F.greatest(n - F.lit(offset), F.lit(0).cast("bigint")))
    else:
        returned = n
    return df.agg(
        n.alias("total_count"),
        returned.cast("bigint").alias("returned"),
        F.lit(offset).cast("bigint").alias("page_offset"),
        *[exact_sum(m).cast("double").alias(m) for m in MEASURES],
    )


def after_key(keys: list[tuple[str, bool]], values: Sequence) -> Column:
    """Rows strictly after ``values`` (a prefix of the key) in key order, in
    which nulls come first, or last where the key descends.

    Written as ``k0 >= v0 AND (k0 > v0 OR (k0 = v0 AND ...))`` so the
    leading bound reaches the Parquet scan as a pushed filter.
    """
    if not values:
        return F.lit(True)
    keys = keys[: len(values)]

    def beyond(c: Column, v, asc: bool) -> Column:
        if v is None:
            return c.isNotNull() if asc else F.lit(False)
        return c > F.lit(v) if asc else c.isNull() | (c < F.lit(v))

    cond = None
    for (k, asc), v in reversed(list(zip(keys, values))):
        c = F.col(k)
        step = beyond(c, v, asc)
        same = c.isNull() if v is None else c == F.lit(v)
        cond = step if cond is None else step | (same & cond)
    (k0, asc0), v0 = keys[0], values[0]
    c0 = F.col(k0)
    if v0 is None:
        return cond if asc0 else c0.isNull() & cond
    return (c0 >= F.lit(v0) if asc0 else c0.isNull() | (c0 <= F.lit(v0))) & cond


def seek_page(
    df: DataFrame, after: Sequence, order_by: Sequence, limit: int, seen: int = 0, tie_break: Sequence[str] = ROW_ORDER
) -> DataFrame:
    """Next ``limit`` rows after the key prefix ``after``.

    ``after`` holds values in sort-key order: the requested keys, then the
    remaining columns (``total_order``). A cursor is the last row's full key
    and ``seen``, the number of rows with that key that were returned so far
    (``next_cursor`` makes it): those are skipped, and rows equal in every
    column are not lost at a page boundary. Without ``seen`` the page starts
    strictly after the key or key prefix.
    """
    keys = total_order(order_by, tie_break)
    cond = after_key(keys, after)
    order = _sort_cols(keys)
    if not seen:
        return top_rows(df.filter(cond), order, limit).orderBy(*order).limit(limit)
    if len(after) != len(keys):
        raise ValueError("seen counts rows of one full key; give all key values")
    same = F.lit(True)
    for (k, _), v in zip(keys, after):
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return top_rows(df.filter(cond | same), order, seen + limit).orderBy(*order).offset(seen).limit(limit)


def next_cursor(
    rows: Sequence, order_by: Sequence, after: Sequence = (), seen: int = 0, tie_break: Sequence[str] = ROW_ORDER
) -> tuple[tuple, int]:
    """(after, seen) that resume after the page ``rows`` (collected rows),
    itself reached with the given cursor."""
    if not rows:
        return tuple(after), seen
    names = [k for k, _ in total_order(order_by, tie_break)]
    key = lambda r: tuple(r[c] for c in names)
    last = key(rows[-1])
    equal = 0
    for r in reversed(rows):
        if key(r) != last:
            break
        equal += 1
    carried = seen if equal == len(rows) and tuple(after) == last else 0
    return last, equal + carried
