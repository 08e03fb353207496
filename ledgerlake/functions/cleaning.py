"""Column expressions that clean raw ledger text (rules N1-N3).

All of them are plain Catalyst expressions, so cleaning runs inside
whole-stage codegen next to the scan; no Python touches the rows. Each
helper is one self-contained expression; ``operators.normalize`` applies
the same rules in three projections (trim, parse, finish) so that a cell
is trimmed and parsed once for a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.schema import UNKNOWN

# Date layouts by the shape of the text, tried in order.
# Ambiguous ones are read month first, and day first only if that is no
# date (15/01/2024); two-digit years are 2000 to 2099. Text tokens that mean
# "missing", and the shape of an accepted number.
_CLOCK = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_CLOCK_FORMAT = "[ H:mm[:ss[.SSSSSSSSS]]]"
DATE_LAYOUTS = [
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}({_CLOCK}(Z|[+-]\d{{2}}:?\d{{2}})?)?$", ["yyyy-M-d" + _CLOCK_FORMAT]),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}({_CLOCK})?$", ["M/d/yyyy" + _CLOCK_FORMAT, "d/M/yyyy" + _CLOCK_FORMAT]),
    (rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}({_CLOCK})?$", ["M-d-yyyy" + _CLOCK_FORMAT, "d-M-yyyy" + _CLOCK_FORMAT]),
    (rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}({_CLOCK})?$", ["yyyy/M/d" + _CLOCK_FORMAT]),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", ["M/d/yy", "d/M/yy"]),
    (r"^\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{4}$", ["d MMM yyyy", "d MMMM yyyy"]),
    (r"^[A-Za-z]{3,9} \d{1,2},? \d{4}$", ["MMM d yyyy", "MMMM d yyyy"]),
]
NULL_TOKENS = ["nan", "NaN", "None", "NA", "N/A", "null", "NULL"]
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# The Unicode White_Space code points (tab, line breaks,
# space, next line, no-break space, ogham space, en quad .. hair space,
# line/paragraph separators, narrow no-break, medium math, ideographic).
WHITESPACE = "".join(
    chr(c)
    for c in [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip_text(c: Column) -> Column:
    """Trim Unicode white space at both ends (``trim`` only drops spaces).

    ``btrim`` with the white-space set is a native character scan, cheaper
    than a regular expression.
    """
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def _with_layouts(s: Column) -> Column:
    # A zone is dropped, not applied: the day is the one that is written.
    zone = F.regexp_replace(s, r"(:\d{2}(\.\d+)?)(Z|[+-]\d{2}:?\d{2})$", "$1")
    plain = F.when(s.rlike(r"^\d{4}-"), F.translate(zone, "T", " ")).when(
        s.rlike("[A-Za-z]{3}"), F.translate(s, "-,", " ")
    ).otherwise(F.translate(s, "T", " "))
    out = None
    for shape, formats in DATE_LAYOUTS:
        day = F.coalesce(*[F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in formats])
        out = F.when(s.rlike(shape), day) if out is None else out.when(s.rlike(shape), day)
    return out


def parse_day(c: Column, formats: Sequence[str] | None = None, trim: bool = True) -> Column:
    """Parse one raw date cell into a DateType value, null if no layout fits.

    Each value is read by its own shape, so one file can mix layouts; only
    the layouts of that shape are tried. Bare numbers never parse. With
    ``formats`` those are tried in order instead.
    """
    s = strip_text(c) if trim else c
    if formats is None:
        return _with_layouts(s)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats])


def date_rejected(c: Column, day: Column) -> Column:
    """1 when a cell that is neither blank nor a missing-token gave no
    ``day``, else 0."""
    s = strip_text(c)
    blank = s.isNull() | (s == "") | s.isin(NULL_TOKENS)
    return F.when(~blank & day.isNull(), 1).otherwise(0)


def date_text(day: Column) -> Column:
    """Render a parsed day as ``yyyy-MM-dd``, or ``Unknown`` when missing."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(UNKNOWN))


def clean_text(c: Column, tokens: Sequence[str] = NULL_TOKENS, trim: bool = True) -> Column:
    """Trim, then turn null / empty / a missing-token into ``Unknown``."""
    s = strip_text(c) if trim else c
    missing = s.isNull() | (s == "") | s.isin(list(tokens))
    return F.when(missing, F.lit(UNKNOWN)).otherwise(s)


# Amounts stay below what decimal(28,4) holds, so that sums are exact. NaN
# sorts above every value in Spark: one range test drops it, both
# infinities and what is too large.
MAX_AMOUNT = 1e24


def parse_number(s: Column) -> Column:
    """Trimmed text -> double when it has the accepted shape, else null."""
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def in_range(v: Column) -> Column:
    """Whether ``v`` is a number that an amount can be."""
    return (v > -MAX_AMOUNT) & (v < MAX_AMOUNT)


def finite(v: Column) -> Column:
    """``v`` when it is a number below MAX_AMOUNT, else null."""
    return F.when(in_range(v), v)


def number_or_null(c: Column, trim: bool = True) -> Column:
    """Accepted decimal or exponent number as double; null otherwise.

    The guard stops Spark from reading ``1d``, ``1f``, ``nan`` or ``inf``
    as numbers; results of 1e24 and more (``1e999``) are rejected as well.
    """
    return finite(parse_number(strip_text(c) if trim else c))


def clean_number(c: Column) -> Column:
    """Missing or rejected -> 0.0 (rule N3)."""
    return F.coalesce(number_or_null(c), F.lit(0.0))


def number_rejected(c: Column) -> Column:
    """1 when a non-blank cell was not accepted as a number, else 0."""
    s = strip_text(c)
    blank = s.isNull() | (s == "")
    return F.when(~blank & number_or_null(c).isNull(), 1).otherwise(0)


def day_of(columns: list[str]) -> Column:
    """The parsed day of a clean ledger: ``txn_day`` when present, else
    derived from the ``yyyy-MM-dd`` text (``Unknown`` -> null)."""
    if "txn_day" in columns:
        return F.col("txn_day")
    return F.to_date(F.try_to_timestamp(F.col("txn_date"), F.lit("yyyy-MM-dd")))
