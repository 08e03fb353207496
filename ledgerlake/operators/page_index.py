"""Pages of a saved ledger by seeking, however deep they are.

``write_page_index`` saves the ledger once for each sort order that pages
are asked in: sorted over the total order, every row with its position
(``row_index``), in folders ``range=<n>`` of ``range_rows`` positions each.
Beside it stands the index: one row for each range with its first position,
its row count and its first key.

* select: the page at an offset lies in the ranges whose positions overlap
  it, and there in the row groups whose ``row_index`` does: a read of one or
  two ranges, the same at any depth;
* rank: the position of a key is the first position of its range plus the
  rows of that one range that stand before it, so a page can start at a key
  and knows its offset.

Positions are counted in ``ordinal.slices``, so rows that are equal in every
column, however many, span tasks and ranges too, and no task sorts more than
a slice, whatever the size of a scan's splits. Nulls come first, or last
where a key descends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.ordinal import SLICE, slices
from ledgerlake.operators.paging import _sort_cols, total_order
from ledgerlake.schema import ROW_ORDER

ROW = "row_index"
RANGE = "range"
#: Rows of one range: a folder, of which a page reads some row groups.
RANGE_ROWS = 1 << 22


@dataclass(frozen=True)
class PageIndex:
    """A saved ledger with positions in one sort order. ``ranges`` has a row
    for each range: ``range``, ``start`` (position of its first row),
    ``row_count`` and ``first`` (the key columns of that row)."""

    rows: DataFrame
    ranges: DataFrame
    keys: list[tuple[str, bool]]

    def total(self) -> int:
        """The number of rows, from the index alone."""
        return self.ranges.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]

    def overlapping(self, offset: int, limit: int) -> list[int]:
        """The ranges that hold the positions of a page."""
        hit = self.ranges.where((F.col("start") < offset + limit) & (F.col("start") + F.col("row_count") > offset))
        return sorted(r[RANGE] for r in hit.select(RANGE).collect())

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows of ``paging.page`` at this offset."""
        where = F.col(RANGE).isin(self.overlapping(offset, limit)) & F.col(ROW).between(offset, offset + limit - 1)
        return self.rows.where(where).orderBy(ROW).drop(RANGE, ROW)

    def rank(self, key: Sequence) -> int:
        """How many rows stand before the first row at or after ``key`` (a
        prefix of the sort key)."""
        later = self.before(key)
        # The last range that starts before the key is the only one that is cut by it.
        found = self.ranges.where(later(lambda c: F.col(f"first.{c}"))).agg(F.max_by(F.struct(RANGE, "start"), "start")).first()[0]
        if found is None:
            return 0
        inside = self.rows.where(F.col(RANGE) == found[RANGE]).where(later(F.col)).count()
        return found["start"] + inside

    def before(self, key: Sequence):
        """Whether a row stands before ``key``, for columns as ``of`` names
        them."""
        keys = self.keys[: len(key)]

        def test(of) -> Column:
            cond = F.lit(False)
            for (name, asc), value in reversed(list(zip(keys, key))):
                c = of(name)
                if value is None:
                    less, same = (F.lit(False), c.isNull()) if asc else (c.isNotNull(), c.isNull())
                else:
                    less, same = (c.isNull() | (c < F.lit(value)) if asc else c > F.lit(value)), c == F.lit(value)
                cond = F.coalesce(less, F.lit(False)) | (F.coalesce(same, F.lit(False)) & cond)
            return cond

        return test

    def page_at(self, key: Sequence, limit: int) -> tuple[int, DataFrame]:
        """(offset, rows): the page that starts at the first row at or after
        ``key``."""
        offset = self.rank(key)
        return offset, self.page(offset, limit)


def write_page_index(
    df: DataFrame,
    path: str,
    order_by: Sequence = (),
    tie_break: Sequence[str] = ROW_ORDER,
    range_rows: int = RANGE_ROWS,
    partitions: int | None = None,
) -> None:
    """Save the rows of ``df`` in the total order of ``order_by`` with their
    positions, and the index of their ranges. They are sorted in
    ``partitions`` slices, or as many as their input's size asks for."""
    keys = total_order(order_by, tie_break)
    order = _sort_cols(keys)
    stored = slices(df, [], order, partitions)
    numbered = stored.numbered(stored.rows, order, ROW).drop(SLICE)
    ranged = numbered.withColumn(RANGE, F.floor(F.col(ROW) / range_rows).cast("int"))
    ranged.sortWithinPartitions(RANGE, ROW).write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows", compression="zstd")
    rows = df.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    ranges = rows.groupBy(RANGE).agg(
        F.min(ROW).alias("start"), F.count(F.lit(1)).alias("row_count"), F.min_by(F.struct(*[k for k, _ in keys]), ROW).alias("first")
    )
    ranges.write.mode("overwrite").parquet(f"{path}/ranges")


def read_page_index(spark: SparkSession, path: str, order_by: Sequence = (), tie_break: Sequence[str] = ROW_ORDER) -> PageIndex:
    """The index that ``write_page_index`` saved with the same order."""
    return PageIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/ranges"), total_order(order_by, tie_break))
