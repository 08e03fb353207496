"""Ledger cleaning (N1-N5): one narrow ``select``, no shuffle.

Typed inputs (Parquet dates, doubles) skip the text parsing; string inputs
go through the rules in ``functions.cleaning``. Cleaning an already clean
ledger returns it unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions import cleaning as C
from ledgerlake.schema import DAY_COLUMN, MEASURES, TEXT_COLUMNS
from ledgerlake.sources.ledger import positional


def _typed(df: DataFrame, name: str, kinds) -> bool:
    return isinstance(df.schema[name].dataType, kinds)


def normalize(
    df: DataFrame,
    drop_zero_rows: bool = False,
    date_formats: Sequence[str] | None = None,
    null_tokens: Sequence[str] = C.NULL_TOKENS,
    with_rejects: bool = False,
) -> DataFrame:
    """Clean a raw ledger (first 10 columns by position).

    Output: the 10 ledger columns (no nulls) + ``txn_day`` (date, null when
    Unknown). ``with_rejects`` adds ``numeric_rejects``: how many non-blank
    measure cells of the row were not numbers, and ``date_rejects``: 1 if a
    date cell that is not blank fits no layout. ``drop_zero_rows`` removes
    rows whose four measures are all zero (each measure tested, so offsetting
    values are kept).

    Three narrow projections (trim, parse, finish) so each cell is trimmed
    and parsed once: Spark does not collapse projections that would repeat
    a regular expression or a cast, and does not share work between the
    branches of one conditional expression.
    """
    raw = positional(df)
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    typed = {c: _typed(raw, c, dates if c == "txn_date" else T.NumericType) for c in ["txn_date", *MEASURES]}

    # 1. trim every text cell once
    trimmed = raw.select(
        *[(F.col(c) if typed.get(c) else C.strip_text(F.col(c))).alias(c) for c in ["txn_date", *TEXT_COLUMNS, *MEASURES]]
    )

    # 2. parse dates and numbers, map missing text
    if typed["txn_date"]:
        day = F.to_date(F.col("txn_date"))
    else:
        day = C.parse_day(F.col("txn_date"), date_formats, trim=False)
    parsed = [day.alias(DAY_COLUMN)]
    if with_rejects:
        parsed.append(F.col("txn_date").cast("string").alias("_s_date"))
    parsed += [C.clean_text(F.col(c), null_tokens, trim=False).alias(c) for c in TEXT_COLUMNS]
    for m in MEASURES:
        v = F.col(m).cast("double") if typed[m] else C.parse_number(F.col(m))
        parsed.append(v.alias(f"_v_{m}"))
        if with_rejects:
            parsed.append(F.col(m).alias(f"_s_{m}"))
    stage = trimmed.select(*parsed)

    # 3. finish: render the date, keep finite numbers (else 0.0), count rejects
    out = [C.date_text(F.col(DAY_COLUMN)).alias("txn_date"), *TEXT_COLUMNS]
    ok = {m: C.in_range(F.col(f"_v_{m}")) for m in MEASURES}
    out += [F.when(ok[m], F.col(f"_v_{m}")).otherwise(F.lit(0.0)).alias(m) for m in MEASURES]
    out.append(F.col(DAY_COLUMN))
    if with_rejects:
        flags = []
        for m in MEASURES:
            s = F.col(f"_s_{m}")
            present = s.isNotNull() if typed[m] else (s.isNotNull() & (s != ""))
            flags.append(F.when(present & ~F.coalesce(ok[m], F.lit(False)), 1).otherwise(0))
        out.append(sum(flags[1:], flags[0]).alias("numeric_rejects"))
        out.append(C.date_rejected(F.col("_s_date"), F.col(DAY_COLUMN)).alias("date_rejects"))
    result = stage.select(*out)
    if drop_zero_rows:
        result = result.filter(non_zero())
    return result


def non_zero() -> Column:
    cond = F.lit(False)
    for m in MEASURES:
        cond = cond | (F.col(m) != 0)
    return cond
