"""Malformed lines of text ledgers, kept apart with their reason.

A ledger file's header says how many fields its lines have. A line with
fewer or more fields, or with a quote that is never closed, is no row of the
ledger: reading it anyway would shift or lose its values. Here such lines
come back as they were written, with their file and the reason, beside the
good rows; every file's own header is checked, and a file whose header has
fewer than 10 columns is rejected as a whole. Good rows and rejects together
are all lines that are not blank.

A line is a record: fields may be quoted (a quote inside is doubled, or
stands after another escape character), but not run over a line end. Everything is a Column
expression. The lines are read twice, first to find each file's first line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.schema import COLUMNS
from ledgerlake.session import ensure_checkpoint_dir

OPEN_QUOTE = "open quote"
TOO_FEW = "too few fields"
TOO_MANY = "too many fields"
BAD_HEADER = "header has too few columns"


def _in_regex(char: str) -> str:
    return "\\" + char if re.match(r"\W", char) else char


def _fields(line: Column, sep: str, quote: str, escape: str) -> tuple[Column, Column]:
    """(number of fields, whether a quote stays open)."""
    s, q, e = map(_in_regex, (sep, quote, escape))
    inside = f"[^{q}]++|{q}{q}" if quote == escape else f"[^{q}{e}]++|{e}."
    quoted = rf"(?<=^|{s}){q}(?:{inside})*+{q}(?={s}|$)"
    # Whole quoted fields become one character, so what is left splits plainly.
    plain = F.regexp_replace(line, quoted, "q")
    return F.size(F.split(plain, s, -1)), F.regexp_like(plain, F.lit(rf"(?:^|{s}){q}"))


def checked_lines(
    spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",", quote: str = '"', escape: str = '"'
) -> DataFrame:
    """Every line that is neither blank nor a header: ``file``, ``line``,
    ``found`` (fields; null with an open quote), ``expected`` (columns of
    the file's header, 10 without headers) and ``reason``, null for a good
    line."""
    ensure_checkpoint_dir(spark)
    # A line's place: its split, and the order in which a task reads it.
    text = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"),
    )
    text = text.where(F.trim("line") != "")
    if header:
        # Checkpointed: one row a file, so that Spark can split the join at a huge one.
        heads = text.groupBy("file").agg(F.min_by("line", "place").alias("head"), F.min("place").alias("first"))
        heads = heads.select("file", "first", _fields(F.col("head"), sep, quote, escape)[0].alias("expected")).checkpoint()
        text = text.join(heads, "file").where(F.col("place") != F.col("first"))
    else:
        text = text.withColumn("expected", F.lit(len(COLUMNS)))
    found, is_open = _fields(F.col("line"), sep, quote, escape)
    judged = text.select("file", "line", found.alias("found"), is_open.alias("is_open"), "expected")
    reason = (
        F.when(F.col("expected") < len(COLUMNS), BAD_HEADER)
        .when(F.col("is_open"), OPEN_QUOTE)
        .when(F.col("found") < F.col("expected"), TOO_FEW)
        .when(F.col("found") > F.col("expected"), TOO_MANY)
    )
    return judged.select("file", "line", F.when(~F.col("is_open"), F.col("found")).alias("found"), "expected", reason.alias("reason"))


def read_checked(
    spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",", quote: str = '"', escape: str = '"'
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the raw ledger rows of the good lines (all columns
    text, for ``normalize``) and the rejected lines with ``file``, ``line``,
    ``found``, ``expected`` and ``reason``."""
    lines = checked_lines(spark, path, header, sep, quote, escape)
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    fields = F.from_csv("line", schema, {"sep": sep, "quote": quote, "escape": escape})
    rows = lines.where("reason IS NULL").select(fields.alias("r")).select("r.*")
    return rows, lines.where("reason IS NOT NULL")


def load_checked(spark: SparkSession, path: str | list[str], ledger_path: str, rejects_path: str, mode: str = "overwrite", **options) -> None:
    """Clean the good lines into a saved ledger and write the rejects as
    JSON lines, so that they can be mended and loaded again."""
    from ledgerlake.operators.normalize import normalize
    from ledgerlake.sources.sinks import write_ledger

    rows, rejects = read_checked(spark, path, **options)
    write_ledger(normalize(rows), ledger_path, mode=mode)
    rejects.write.mode(mode).json(rejects_path)
