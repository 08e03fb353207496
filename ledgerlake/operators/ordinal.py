"""Row numbers within groups (or globally) without a group in one task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends each group to one
task, so a group holding a third of the ledger becomes one huge sort.
``slices`` range-partitions the rows on ``(g, k)`` and, last, a hash
of where the row stands, so that even rows equal in every column are spread
and a big group simply spans several consecutive partitions. Each row is
numbered inside its (partition, group) slice; only the groups cut by a
partition boundary need an offset, about two for each partition.

The slices are written once as Parquet, a table bucketed by slice under the
shared checkpoint folder: range bounds come from sampling, and every later
branch (and any recomputation after a lost executor) must see the very same
slices. As Spark knows that a bucket is a slice, windows and aggregates by
(slice, group) follow the scan without another shuffle. Building such a
frame therefore runs jobs, and its files stay in that folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.session import ensure_checkpoint_dir, shared_dir

# Spark drops rows beyond this rank before the shuffle of a window.
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
# Input bytes for each range partition, and for each that a task sorts,
# numbers and adds up: as rows they take up to twenty times that.
PARTITION_BYTES = 128 << 20
SLICE_BYTES = 8 << 20
# The range partition of a row, as a value that has a bucket of its own.
SLICE = "_slice"
# Sampled rows that the first rows of a group make, about.
SAMPLE_RANK = 400
SAMPLE_SEED = 7
# Thresholds of large groups that a task may hold, and the tasks over which
# a group is dealt where there are more.
MAX_BROADCAST = 100_000
SALTS = 32
# Places over which equal rows are dealt.
SPREAD = 1 << 16
# Relations without statistics claim more than any table holds.
UNKNOWN_BYTES = 1 << 60


def first_in_groups(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], limit: int, out: str = "_n"
) -> DataFrame:
    """Rows at the 0-based positions below ``limit`` of their group, in the
    ascending order of ``order_cols``, nulls first.

    For limits that Spark applies before the shuffle (1000 by default), a
    ``row_number() <= limit`` window: no group sends more than ``limit`` rows
    from a task. For larger ones the rows that can be among the first are
    numbered by ``number_rows``.
    """
    group_cols, names = list(group_cols), list(order_cols)
    order = [F.col(c).asc_nulls_first() for c in names]
    if limit > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        # The planner's size of what is left, a join, would be far too large.
        parts = partition_count(df, None, SLICE_BYTES)
        return number_rows(among_first(df, group_cols, names, limit), group_cols, order, out, parts).filter(F.col(out) < limit)
    w = Window.partitionBy(*group_cols).orderBy(*order)
    # Directly on row_number() so Spark plans WindowGroupLimit.
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return ranked.withColumn(out, (F.col("_rn") - 1).cast("long")).drop("_rn")


def among_first(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], limit: int) -> DataFrame:
    """``df`` without rows that can't be among the first ``limit`` of their
    group: of a group much larger than ``limit`` little more than that many
    rows stay, and no others are sorted or sent anywhere.

    A sample in which the first ``limit`` rows of a group make about
    ``SAMPLE_RANK`` gives each large group a threshold, the key of the sample's row a
    quarter further on. It holds only if a count finds at least ``limit``
    rows up to it, so a poor sample costs time, never rows. Groups with too
    few sampled rows have no threshold: they are hardly larger than ``limit``.
    """
    keys, names = list(group_cols), list(order_cols)
    ensure_checkpoint_dir(df.sparkSession)
    rank = SAMPLE_RANK + SAMPLE_RANK // 4
    sampled = df.select(*dict.fromkeys([*keys, *names])).where(F.rand(SAMPLE_SEED) < SAMPLE_RANK / limit)
    firsts = first_in_groups(sampled, keys, names, rank, "_place")
    key = F.struct(*names)
    found = firsts.groupBy(*keys).agg(F.max(key).alias("_last"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") == rank).drop("_rows").checkpoint()
    thresholds = found.count()
    if not thresholds:
        return df
    # A join by the group would sort a large group in one task.
    join = null_safe_join if thresholds <= MAX_BROADCAST else _salted_join
    passed = join(df, F.broadcast(found) if thresholds <= MAX_BROADCAST else found, keys, "inner").where(key <= F.col("_last"))
    enough = passed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max("_last").alias("_last")).where(F.col("_rows") >= limit).drop("_rows").checkpoint()
    kept = join(df, F.broadcast(enough) if thresholds <= MAX_BROADCAST else enough, keys, "left").where(F.col("_last").isNull() | (key <= F.col("_last")))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def _salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """``null_safe_join`` with a row for each key on the right: the rows of
    a key on the left are dealt to ``SALTS`` tasks."""
    salted = left.withColumn("_salt", F.pmod(spread_key(), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return null_safe_join(salted, copies, [*on, "_salt"], how).drop("_salt")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the relations that ``df`` reads, as far as the plan knows
    them (a join's own estimate multiplies its sides)."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    except AttributeError:  # Spark Connect has no plan here
        return 0
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def partition_count(df: DataFrame, partitions: int | None, size: int = PARTITION_BYTES) -> int:
    """The given count, or one by the size of the input, at least
    ``spark.sql.shuffle.partitions``."""
    if partitions:
        return partitions
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // size))


def spread_key() -> Column:
    """A last range key that deals rows equal in all others to ``SPREAD``
    places; two bytes, as every row carries it through the shuffle."""
    return F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(SPREAD)).cast("int")


def bucket_values(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers, of which each falls into another of ``n`` buckets."""
    tried = 32 * n
    while True:
        ids = spark.range(0, tried, 1, 1).select(F.col("id").cast("int").alias("v"))
        found = ids.groupBy(F.expr(f"pmod(hash(v), {n})").alias("b")).agg(F.min("v").alias("v")).orderBy("b").collect()
        if len(found) == n:
            return [r["v"] for r in found]
        tried *= 2


@dataclass(frozen=True)
class Slices:
    """Rows in the slices of a range partitioning, stored: ``rows`` has their
    slice in ``SLICE``, one of ``count``, ``order`` places a slice among the
    others, and ``cut`` has the groups that may go on in another slice
    (``None`` without groups, when all rows are one)."""

    rows: DataFrame
    groups: list[str]
    order: Column
    cut: DataFrame | None
    count: int

    def whole(self) -> DataFrame:
        """Rows of the groups that are in one slice: what is grouped by
        ``SLICE`` and more needs no shuffle."""
        return null_safe_join(self.rows, F.broadcast(self.cut), self.groups, "left_anti")

    def rest(self) -> DataFrame:
        """Rows of the other groups, at most two for each slice."""
        if self.cut is None:
            return self.rows
        return null_safe_join(self.rows, F.broadcast(self.cut), self.groups, "left_semi")

    def numbered(self, rows: DataFrame, order_cols: Sequence[Column], out: str, weight: str | None = None) -> DataFrame:
        """Add ``out`` to ``rows`` (``rows``, ``whole()`` or ``rest()``): see
        ``number_rows``."""
        w = Window.partitionBy(SLICE, *self.groups).orderBy(*order_cols)
        place = F.row_number().over(w) - 1
        if weight:
            place = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        local = rows.withColumn("_local", place)
        counts = self.rest().groupBy(*self.groups, SLICE).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count"))
        before = Window.partitionBy(*self.groups).orderBy(self.order).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*self.groups, SLICE, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
        # At most three rows for each slice.
        joined = null_safe_join(local, F.broadcast(offsets), [*self.groups, SLICE], "left")
        n_col = (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_local")).cast("long").alias(out)
        return joined.select(*[F.col(f"`{c}`") for c in rows.columns], n_col)


def stored_ranges(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], sort_cols: Sequence[str], partitions: int | None = None) -> tuple[DataFrame, Column, int]:
    """``df`` ranged by group and order and stored, each slice written in the
    order of ``sort_cols``: one shuffle of its rows. The rows with ``SLICE``,
    the place of a slice among the others, and their count.

    An explicit partition count keeps AQE from re-cutting the range
    partitions, so each task writes the one file of its slice's bucket.
    """
    spark, n = df.sparkSession, partition_count(df, partitions, SLICE_BYTES)
    path = shared_dir(spark, name := f"slices_{uuid.uuid4().hex}")
    values = f"array({', '.join(map(str, bucket_values(spark, n)))})"
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + list(order_cols)
    ranged = range_partitioned(df, n, keys).withColumn(SLICE, F.expr(f"element_at({values}, spark_partition_id() + 1)"))
    writer = ranged.write.options(path=path, compression="zstd").bucketBy(n, SLICE)
    (writer.sortBy(*sort_cols) if sort_cols else writer).saveAsTable(name)
    return spark.table(name), F.expr(f"array_position({values}, {SLICE})"), n


def slices(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], partitions: int | None = None) -> Slices:
    """``df`` ranged by group and order and stored: see ``stored_ranges``."""
    groups = list(group_cols)
    rows, place, n = stored_ranges(df, groups, order_cols, groups, partitions)
    if not groups:
        return Slices(rows, groups, place, None, n)
    # Groups that can continue across a boundary: first and last group of
    # every slice.
    key = F.struct(*[F.col(g) for g in groups])
    ends = rows.groupBy(SLICE).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    cut = ends.select(F.explode(F.array("first", "last")).alias("k")).select(*[F.col(f"k.{g}").alias(g) for g in groups]).distinct()
    return Slices(rows, groups, place, cut.checkpoint(), n)


def number_rows(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column],
    out: str = "_n",
    partitions: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Add ``out``: 0-based position of the row inside its group in
    ``order_cols`` order (global position when ``group_cols`` is empty).
    With ``weight``, a column of whole numbers, the sum of the weights that
    stand before the row instead (needs ``group_cols``).

    ``order_cols`` must make the order total up to identical rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not group_cols:
        if weight:
            raise ValueError("running sums of weights need a group column")
        keys = list(order_cols)
        return _number_globally(df, keys, partition_count(df, partitions, SLICE_BYTES), out)
    stored = slices(df, group_cols, order_cols, partitions)
    return stored.numbered(stored.rows, order_cols, out, weight).drop(SLICE)


def _number_globally(df: DataFrame, keys: list[Column], n: int, out: str) -> DataFrame:
    """Global position: sort each range partition, and store its rows as
    Parquet with their place in it, read from ``monotonically_increasing_id``
    (partition index << 33 | row index). Only the per-partition counts (one
    row per partition) are joined back."""
    path = shared_dir(df.sparkSession, f"ranged-{uuid.uuid4().hex}")
    pid = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    range_partitioned(df, n, keys).sortWithinPartitions(*keys).select("*", pid.alias("_pid"), local.alias("_local")).write.parquet(path)
    tagged = df.sparkSession.read.parquet(path)
    counts = tagged.groupBy("_pid").count()
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_pid").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    joined = tagged.join(F.broadcast(offsets), F.col("_pid") == F.col("_p"))
    n_col = (F.col("_offset") + F.col("_local")).cast("long").alias(out)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], n_col)


def range_partitioned(df: DataFrame, n: int, keys: list[Column]) -> DataFrame:
    """``n`` ranges of ``keys``, over which equal rows are spread too."""
    return df.withColumn("_spread", spread_key()).repartitionByRange(n, *keys, F.col("_spread")).drop("_spread")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join whose keys may be null on both sides; the right keys are dropped."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}" if c in on else c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`"))
    out = left.join(renamed, cond, how)
    return out.drop(*[f"_r_{c}" for c in on])
