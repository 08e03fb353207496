"""Read ledger files.

A ledger is 10 columns by position; header names are ignored. Fewer than
10 columns is an error, extra columns are dropped. Text formats are read
with every column as a string so that cleaning decides what a value means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.schema import COLUMNS, DISPLAY_NAMES

_BY_NAME = {**{v: k for k, v in DISPLAY_NAMES.items()}, **{c: c for c in COLUMNS}}


def positional(df: DataFrame) -> DataFrame:
    """Keep the first 10 columns and give them the ledger names."""
    n = len(df.columns)
    if n < len(COLUMNS):
        raise ValueError(f"a ledger has {len(COLUMNS)} columns, this one has {n}")
    first = df.columns[: len(COLUMNS)]
    return df.select([F.col(f"`{src}`").alias(dst) for src, dst in zip(first, COLUMNS)])


def json_ledger(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """JSON objects (one in a line, or with ``multiline`` an array or object
    in a file) by field name: display labels or snake_case names, missing
    fields become null. Every value is read as the text that was written:
    no pass to infer types, and cleaning decides what it means."""
    kind = "array<map<string,string>>" if multiline else "map<string,string>"
    fields = F.from_json("value", kind)
    rows = spark.read.text(path, wholetext=multiline).where(F.trim("value") != "")
    rows = rows.select((F.explode(fields) if multiline else fields).alias("m"))
    names = {c: [n for n, own in _BY_NAME.items() if own == c] for c in COLUMNS}
    return rows.select([F.coalesce(*[F.col("m")[n] for n in names[c]]).alias(c) for c in COLUMNS])


def read_ledger(spark: SparkSession, path: str | list[str], fmt: str = "csv", header: bool = True, **options) -> DataFrame:
    """Raw (uncleaned) ledger from one path, a glob, a folder or a list.

    ``fmt`` is any Spark file source: ``csv`` (strings, no inference),
    ``parquet`` / ``orc`` (typed columns are fine, cleaning handles them),
    ``json`` (matched by field name), or ``xlsx`` (first sheet of every
    workbook, see ``sources.workbook``).
    """
    if fmt == "xlsx":
        from ledgerlake.sources.workbook import read_workbooks

        return read_workbooks(spark, path)
    if fmt == "json":
        return json_ledger(spark, path, str(options.get("multiLine", False)).lower() == "true")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("inferSchema", False).option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    return positional(reader.load(path))
