"""Continuous ledger loading with Structured Streaming.

The reference loads a file when the user uploads it. Here new ledger files
dropped into a folder are picked up by a file stream, cleaned with the same
``normalize`` (a stateless, per-row ``select``) and appended to the saved
Parquet ledger. The checkpoint makes the load exactly-once: a restarted
query (or a lost executor) re-reads only uncommitted files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.normalize import normalize
from ledgerlake.schema import COLUMNS, DISPLAY_NAMES, RAW_SCHEMA


def ledger_stream(spark: SparkSession, folder: str, fmt: str = "csv", max_files: int = 100) -> DataFrame:
    """Raw ledger files arriving in ``folder`` as a cleaned streaming frame.

    CSV is read positionally with the all-string raw schema (header row
    skipped), so column names in the files do not matter. JSON records are
    matched by name (snake_case or display label).
    """
    if fmt == "json":
        # JSON Lines, keys snake_case or display labels (either case):
        # parsed into a string map, so each key is looked up exactly.
        lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
        record = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
        raw = lines.select(record.alias("r")).select(
            *[F.coalesce(F.col("r")[c], F.col("r")[DISPLAY_NAMES[c]]).alias(c) for c in COLUMNS]
        )
    else:
        reader = spark.readStream.format(fmt).schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files)
        if fmt == "csv":
            reader = reader.option("header", True)
        raw = reader.load(folder)
    return normalize(raw)


def start_ingest(
    spark: SparkSession,
    folder: str,
    ledger_path: str,
    checkpoint: str,
    fmt: str = "csv",
    available_now: bool = False,
) -> StreamingQuery:
    """Append cleaned rows from ``folder`` to the Parquet ledger at
    ``ledger_path``. ``available_now`` processes what is there and stops."""
    writer = (
        ledger_stream(spark, folder, fmt)
        .writeStream.format("parquet")
        .option("path", ledger_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
