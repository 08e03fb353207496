"""A rollup that is kept up as the ledger grows.

The saved state holds one row for each full (date, type, sub type, name)
group of a batch, with mergeable sums: the row count, the integer limbs of
every measure and the decimal rest (``functions.aggregates``), never a
double. Merging is plain addition, so the rollup over any split of the
ledger into batches equals the rollup over the whole, to the last digit.

Layout under one folder:

* ``state/batch=<id>``: the groups of one folded batch. Folding a batch
  writes its folder anew, so a batch that is retried after a failure counts
  once; with the epoch of a stream as id, folding is exactly once.
* ``base/gen=<n>`` and ``folded/gen=<n>``: after ``compact``, all batches
  so far merged into one row for each group, and their ids. The ids are
  written last: they commit the generation, and from then on the batches
  they name are read from ``base`` only. A compaction that fails half-way
  leaves the previous generation in force.

Reading merges the newest generation with the batches folded since: work
in proportion to groups, not to transactions. One writer at a time folds
and compacts; readers may run meanwhile.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.functions.aggregates import limb_columns, limb_fields
from ledgerlake.operators.rollup import rollup_of_groups
from ledgerlake.schema import DIMS
from ledgerlake.session import ensure_checkpoint_dir
from ledgerlake.streaming.ingest import ledger_stream

_SAFE_ID = re.compile(r"[A-Za-z0-9_.-]+")
_FIELDS = [*[(d, "string") for d in DIMS], ("row_count", "bigint"), *limb_fields()]
_STATE = ", ".join(f"{name} {kind}" for name, kind in _FIELDS)


def merge_state(state: DataFrame) -> DataFrame:
    """Rows of the same group added up."""
    return state.groupBy(*DIMS).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in _FIELDS[len(DIMS) :]])


def group_state(df: DataFrame) -> DataFrame:
    """One mergeable row for each full group of ``df``."""
    return merge_state(df.select(*DIMS, F.lit(1).cast("long").alias("row_count"), *limb_columns()))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """The state of every folded batch that is still there, with ``batch``."""
    if not _exists(spark, f"{path}/state"):
        return spark.createDataFrame([], f"{_STATE}, batch string")
    return spark.read.schema(f"{_STATE}, batch string").parquet(f"{path}/state")


def _base(spark: SparkSession, path: str, gen: int) -> DataFrame:
    if not gen:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).parquet(f"{path}/base/gen={gen}")


def generation(spark: SparkSession, path: str) -> int:
    """The newest committed generation, 0 before the first compaction."""
    if not _exists(spark, f"{path}/folded"):
        return 0
    found = spark.read.schema("batch string, gen int").parquet(f"{path}/folded").agg(F.max("gen")).first()[0]
    return found or 0


def folded_batches(spark: SparkSession, path: str) -> DataFrame:
    """``batch``: the ids that the newest generation has merged."""
    gen = generation(spark, path)
    if not gen:
        return spark.createDataFrame([], "batch string")
    return spark.read.parquet(f"{path}/folded/gen={gen}").select("batch")


def fold(batch: DataFrame, path: str, batch_id: str | int) -> bool:
    """Add the rows of ``batch`` to the state. Folding the same id again
    replaces what it wrote before; once it is compacted, a retry changes
    nothing. Returns whether state was written."""
    name = str(batch_id)
    if not _SAFE_ID.fullmatch(name):
        raise ValueError(f"a batch id is made of letters, digits and ._-, got {name!r}")
    spark = batch.sparkSession
    if not folded_batches(spark, path).where(F.col("batch") == name).isEmpty():
        return False
    group_state(batch).write.mode("overwrite").parquet(f"{path}/state/batch={name}")
    return True


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """All state rows in force: the newest generation and the batches that
    it does not hold."""
    since = _batches(spark, path).join(folded_batches(spark, path), "batch", "left_anti").drop("batch")
    return _base(spark, path, generation(spark, path)).unionByName(since)


def compact(spark: SparkSession, path: str) -> int:
    """Merge everything in force into a new generation; returns its number.
    Batches folded while it runs are left for the next one."""
    ensure_checkpoint_dir(spark)
    gen, done, batches = generation(spark, path), folded_batches(spark, path), _batches(spark, path)
    # The ids are fixed before the state is read, and committed after it is written.
    fresh = batches.select("batch").distinct().join(done, "batch", "left_anti").checkpoint()
    rows = _base(spark, path, gen).unionByName(batches.join(fresh, "batch", "left_semi").drop("batch"))
    # Rows of a group, one a batch, meet in a range: one shuffle merges and sorts.
    merge_state(rows.repartitionByRange(*DIMS)).sortWithinPartitions(*DIMS).write.mode("overwrite").parquet(f"{path}/base/gen={gen + 1}")
    done.unionByName(fresh).write.mode("overwrite").parquet(f"{path}/folded/gen={gen + 1}")
    return gen + 1


def rollup_of_state(state: DataFrame) -> DataFrame:
    """The rows of ``rollup.rollup_table`` from mergeable state: groups are
    added up once, and the levels above from their sums."""
    return rollup_of_groups(merge_state(state).withColumnRenamed("row_count", "__rows"))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The kept-up rollup, in the shape of ``rollup.rollup_table``: use it
    with ``rollup_lookup``, ``rollup_children`` and ``rollup_options``."""
    return rollup_of_state(read_state(spark, path))


def start_rollup_ingest(
    spark: SparkSession, folder: str, path: str, checkpoint: str, fmt: str = "csv", available_now: bool = False
) -> StreamingQuery:
    """Fold the ledger files that arrive in ``folder`` into the state at
    ``path``, each stream batch exactly once."""
    writer = ledger_stream(spark, folder, fmt).writeStream.foreachBatch(lambda df, epoch: fold(df, path, f"epoch-{epoch}"))
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
