"""Sinks: saved ledger layout, report files, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.operators.ordinal import partition_count, range_partitioned
from ledgerlake.schema import COLUMNS, ROW_ORDER


MONTH_COLUMN = "txn_month"


def write_ledger(
    df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None, by_month: bool = False
) -> None:
    """Save a clean ledger as Parquet, range-partitioned and sorted by the
    four levels (then the other columns), in files by the size of the input
    (or ``partitions`` of them): a date or date-range filter skips
    whole files and row groups by their min/max statistics, and equality
    filters on the other levels use dictionary filtering. Ranging on the
    full row order, and last on a spread key, lets Spark split even one
    (date, entity) key, or one repeated row, that holds a large share of the
    rows over several files.

    ``by_month`` also writes one ``txn_month=yyyy-MM`` directory per month
    (``Unknown`` for missing dates): date filters then prune whole
    directories (read back with ``read_saved_ledger``). Each task covers a
    contiguous date range, so it writes into few directories.
    """
    keys = [c for c in ROW_ORDER if c in df.columns]
    if by_month:
        df = df.withColumn(MONTH_COLUMN, F.substring("txn_date", 1, 7))
    ranged = range_partitioned(df, partition_count(df, partitions), [F.col(k) for k in keys])
    writer = ranged.sortWithinPartitions(*keys).write.mode(mode)
    if by_month:
        writer = writer.partitionBy(MONTH_COLUMN)
    writer.parquet(path)


def read_saved_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read a ledger saved by ``write_ledger`` (either layout) with its
    schema pinned, so a month directory is never re-typed as a date."""
    from ledgerlake.schema import CLEAN_SCHEMA

    df = spark.read.parquet(path)
    if MONTH_COLUMN not in df.columns:
        return df
    schema = T.StructType([*CLEAN_SCHEMA.fields, T.StructField(MONTH_COLUMN, T.StringType(), True)])
    return spark.read.schema(schema).parquet(path)


def write_report(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", ordered: bool = True
) -> None:
    """Write an ``export_report`` result; CSV gets a header row. Files are
    written in parallel, one per task. With ``ordered`` the rows are sorted
    (range-partitioned, so no single task sorts everything) by ``is_total``
    and then the ledger columns: the part files, in name order, read like
    the report, with the TOTAL row last."""
    if ordered and "is_total" in df.columns:
        df = df.orderBy("is_total", *[c for c in COLUMNS if c in df.columns])
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row (``record`` column), ledger columns only."""
    cols = [c for c in COLUMNS if c in df.columns]
    return df.select(F.to_json(F.struct(*cols)).alias("record"))
