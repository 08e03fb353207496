"""Exact measure sums.

Measures are stored as double but summed exactly, as
``sum(cast(x as decimal(28,4)))`` would: each amount becomes a count of
1e-4 units. An amount below 1e11 with at most four decimals (its units,
divided back, give the same double) takes a fast path: the units are split
into three 21-bit limbs and each limb is summed as a ``long`` (plain,
codegen-friendly hash-aggregate buffers, with a map-side partial phase).
Every other amount is turned into ``decimal(28,4)`` by its shortest decimal
text and summed as decimal. The
result is the same on either path: two decimals of at most 15 digits never
share a double. After the aggregate both are added once per group in
``decimal(38,4)`` and returned as double.

The result does not depend on row or partition order (double sums do), and
a limb sum cannot overflow below 2^42 rows per group. Cleaning rejects (and
counts) amounts of 1e24 or more, which ``decimal(28,4)`` can't hold; a sum
over an uncleaned one stops the query, with ANSI mode on or off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.cleaning import MAX_AMOUNT
from ledgerlake.schema import MEASURES

SCALE = 4
_UNIT = 10.0**SCALE
_LIMB_BITS = 21
_LIMBS = 3
_WIDE_BITS = 25
_MASK = (1 << _LIMB_BITS) - 1
SUM_TYPE = "decimal(38,4)"
AMOUNT_TYPE = "decimal(28,4)"


def _fast_sql(name: str) -> str:
    x = f"CAST(`{name}` AS DOUBLE)"
    return f"(abs({x}) < 1E11 AND rint({x} * {_UNIT:.1E}) / {_UNIT:.1E} = {x})"


def _units_sql(name: str) -> str:
    return f"CASE WHEN {_fast_sql(name)} THEN CAST(rint(CAST(`{name}` AS DOUBLE) * {_UNIT:.1E}) AS BIGINT) ELSE 0L END"


def _other_sql(name: str) -> str:
    """The amount as a decimal when it is not on the fast path, else null."""
    x = f"CAST(`{name}` AS DOUBLE)"
    return (
        f"CASE WHEN {x} IS NULL OR {_fast_sql(name)} THEN NULL "
        f"WHEN abs({x}) >= {MAX_AMOUNT:.1E} THEN CAST(raise_error(concat('amount out of range: ', {x})) AS {AMOUNT_TYPE}) "
        # The shortest text that reads as the same double: older JVMs print
        # some doubles with a digit too many.
        + "".join(
            f"WHEN CAST(format_string('%.{d}e', {x}) AS DOUBLE) = {x} THEN CAST(format_string('%.{d}e', {x}) AS {AMOUNT_TYPE}) "
            for d in (14, 15, 16)
        )
        + f"ELSE CAST({x} AS {AMOUNT_TYPE}) END"
    )


def _limb_sql(name: str, i: int) -> str:
    limb = f"shiftright({_units_sql(name)}, {_LIMB_BITS * i})"
    return limb + (f" & {_MASK}" if i < _LIMBS - 1 else "")


def _limb_name(name: str, i: int) -> str:
    return f"__limb_{name}_{i}"


def limb_fields(measures: Sequence[str] = MEASURES) -> list[tuple[str, str]]:
    """(name, type) of the sums that add up without loss: the limbs of every
    measure and its decimal rest, named as in ``limb_columns``."""
    types = ["bigint"] * _LIMBS + [SUM_TYPE]
    return [(_limb_name(m, i), kind) for m in measures for i, kind in enumerate(types)]


def limb_columns(measures: Sequence[str] = MEASURES) -> list[Column]:
    """The limbs (and the decimal rest) of every measure as columns, to
    project once before an ``Expand`` (rollup) instead of recomputing them
    for every copied row."""
    limbs = [F.expr(_limb_sql(m, i)).alias(_limb_name(m, i)) for m in measures for i in range(_LIMBS)]
    return limbs + [F.expr(_other_sql(m)).alias(_limb_name(m, _LIMBS)) for m in measures]


def _recombined_sql(sums: Sequence[str], bits: int = _LIMB_BITS) -> str:
    """SQL text of ``decimal(38,4)`` from the sums of a measure's limbs and
    of its decimal rest."""
    parts = []
    for i, s in enumerate(sums[:-1]):
        limb = f"CAST(COALESCE({s}, 0) AS DECIMAL(38,0))"
        parts.append(limb if i == 0 else f"{limb} * CAST({1 << (bits * i)} AS DECIMAL(38,0))")
    fast = f"CAST(({' + '.join(parts)}) / {10**SCALE} AS {SUM_TYPE})"
    return f"CAST({fast} + COALESCE(CAST({sums[-1]} AS {SUM_TYPE}), CAST(0 AS {SUM_TYPE})) AS {SUM_TYPE})"


def unit_columns(measures: Sequence[str] = MEASURES) -> list[Column]:
    """The measures in whole units where they are on the fast path, else
    null: what ``wide_columns`` is made from."""
    units = "CASE WHEN {} THEN CAST(rint(CAST(`{}` AS DOUBLE) * {:.1E}) AS BIGINT) END"
    return [F.expr(units.format(_fast_sql(m), m, _UNIT)).alias(f"__units_{m}") for m in measures]


def _wide_rest_sql(name: str) -> str:
    """``_other_sql`` beside ``unit_columns``, with a single cast: its
    generated code stays short where all measures are made at once."""
    x = f"CAST(`{name}` AS DOUBLE)"
    short, long, full = (f"format_string('%.{d}e', {x})" for d in (14, 15, 16))
    text = f"CASE WHEN CAST({short} AS DOUBLE) = {x} THEN {short} WHEN CAST({long} AS DOUBLE) = {x} THEN {long} ELSE {full} END"
    checked = f"CASE WHEN abs({x}) >= {MAX_AMOUNT:.1E} THEN raise_error(concat('amount out of range: ', {x})) ELSE {text} END"
    return f"CASE WHEN `__units_{name}` IS NULL AND {x} IS NOT NULL THEN CAST({checked} AS {AMOUNT_TYPE}) END"


def wide_columns(measures: Sequence[str] = MEASURES) -> list[Column]:
    """Every measure as two limbs of its units, null off the fast path, and
    its decimal rest: fewer columns than ``limb_columns`` for sums that are
    kept with every row. They add up without loss below 2^38 rows; carried
    (``wide_carried``), only the high limbs of 2^38 amounts near 1e11 would
    not."""
    out = []
    for m in measures:
        units = f"`__units_{m}`"
        limbs = [f"{units} & {(1 << _WIDE_BITS) - 1}L", f"shiftright({units}, {_WIDE_BITS})", _wide_rest_sql(m)]
        out += [F.expr(x).alias(name) for x, name in zip(limbs, wide_names([m]))]
    return out


def wide_names(measures: Sequence[str] = MEASURES) -> list[str]:
    return [f"__{part}_{m}" for m in measures for part in ("low", "high", "rest")]


def wide_carried(measures: Sequence[str] = MEASURES) -> list[Column]:
    """Sums of ``wide_columns`` with the low limbs' carry in the high ones,
    to be added up further."""
    out = []
    for low, high, rest in (wide_names([m]) for m in measures):
        limbs = [f"`{low}` & {(1 << _WIDE_BITS) - 1}L", f"`{high}` + shiftright(`{low}`, {_WIDE_BITS})", f"`{rest}`"]
        out += [F.expr(x).alias(n) for x, n in zip(limbs, (low, high, rest))]
    return out


def wide_units_sql(name: str) -> str:
    """SQL text of a measure's sum in whole units from the sums of its
    ``wide_columns`` (over less than 2^37 rows, or carried); null where it may
    have more digits than a double."""
    low, high, rest = (f"`{n}`" for n in wide_names([name]))
    small = f"{rest} IS NULL AND COALESCE({high}, 0L) BETWEEN {-(1 << 36)}L AND {1 << 36}L"
    return f"CASE WHEN {small} THEN COALESCE({low}, 0L) + COALESCE({high}, 0L) * {1 << _WIDE_BITS}L END"


def wide_sum_text_sql(name: str, units: str) -> str:
    """SQL text of a measure's sum as ``finish_measures`` gives it and JSON
    writes it, from ``units`` (``wide_units_sql``) or the sums themselves."""
    slow = f"CAST(CAST({_recombined_sql([f'`{n}`' for n in wide_names([name])], _WIDE_BITS)} AS DOUBLE) AS {SUM_TYPE})"
    # Below 1e15 the double nearest to the sum has the sum's digits.
    return f"CASE WHEN abs({units}) < {10**15}L THEN {units_text_sql(units)} ELSE CAST({slow} AS STRING) END"


def units_text_sql(units: str) -> str:
    """SQL text of whole units, below 1e15, as a number with four decimals."""
    return f"CAST(CAST({units} AS DECIMAL(15,0)) * {1 / 10**SCALE:.{SCALE}f}BD AS STRING)"


def exact_sum_sql(name: str) -> str:
    """SQL text of the exact sum of column ``name`` as ``decimal(38,4)``:
    three ``long`` limb sums, recombined, plus the decimal sum of the amounts
    off the fast path. Written as SQL text so a whole aggregate list costs a
    few JVM calls to build."""
    return _recombined_sql([f"SUM({x})" for x in (*[_limb_sql(name, i) for i in range(_LIMBS)], _other_sql(name))])


def exact_sum(c: str) -> Column:
    """Exact sum of amount column ``c`` as ``decimal(38,4)`` (0 over no rows)."""
    return F.expr(exact_sum_sql(c))


def measure_aggs(gross: bool = True, count_name: str = "row_count", measures: Sequence[str] = MEASURES) -> list[Column]:
    """``row_count``, the exact measure sums (double) and ``gross_total`` as
    plain aggregates, for a frame that is aggregated once."""
    dec = {m: exact_sum_sql(m) for m in measures}
    out = [F.count(F.lit(1)).alias(count_name)] + [F.expr(f"CAST({dec[m]} AS DOUBLE) AS `{m}`") for m in measures]
    if gross:
        out.append(F.expr(f"CAST({' + '.join(dec[m] for m in measures)} AS DOUBLE) AS gross_total"))
    return out


def finish_measures(
    sums: DataFrame, count: Column, gross: bool = True, nets: bool = False, count_name: str = "row_count", measures: Sequence[str] = MEASURES
) -> DataFrame:
    """The columns of ``sums`` that are no limb sums, with ``row_count``, the
    exact measure sums (double), ``gross_total`` (sum of the four) and, with
    ``nets``, ``cash_net`` / ``bank_net`` (Dr - Cr) from its ``limb_fields``.

    Two projections: each measure is recombined once, in a method of its
    own. In the aggregate's own output they would make a generated method
    that is too long for the JVM to compile.
    """
    limbs = {name for name, _ in limb_fields(measures)}
    others = [c for c in sums.columns if c not in limbs and c != "__rows"]
    decimals = {m: _recombined_sql([f"`{_limb_name(m, i)}`" for i in range(_LIMBS + 1)]) for m in measures}
    once = sums.select(*[F.col(f"`{c}`") for c in others], count.alias("__rows"), *[F.expr(d).alias(f"__sum_{m}") for m, d in decimals.items()])
    out = [F.col("__rows").alias(count_name)] + [F.col(f"__sum_{m}").cast("double").alias(m) for m in measures]
    if gross:
        out.append(F.expr(f"CAST({' + '.join(f'__sum_{m}' for m in measures)} AS DOUBLE) AS gross_total"))
    if nets:
        out.append(F.expr("CAST(__sum_cash_dr - __sum_cash_cr AS DOUBLE) AS cash_net"))
        out.append(F.expr("CAST(__sum_bank_dr - __sum_bank_cr AS DOUBLE) AS bank_net"))
    return once.select(*[F.col(f"`{c}`") for c in others], *out)


def group_measures(
    df: DataFrame, keys: Sequence[str], *extra: Column, rollup: bool = False, **kw
) -> DataFrame:
    """Group ``df`` by the ``keys`` columns (``rollup`` for every prefix)
    into the keys, the ``extra`` aggregates and ``finish_measures``.

    The limbs are projected once per row first: cheaper than recomputing
    them inside every sum, and below the ``Expand`` of a rollup they are not
    recomputed for each copied row.
    """
    keys = list(keys)
    pre = df.select(*[F.col(f"`{k}`") for k in keys], *limb_columns())
    grouped = pre.rollup(*keys) if rollup else pre.groupBy(*keys)
    sums = [F.sum(name).alias(name) for name, _ in limb_fields()]
    return finish_measures(grouped.agg(*extra, F.count(F.lit(1)).alias("__rows"), *sums), F.col("__rows"), **kw)


def totals_of(df: DataFrame, **kw) -> DataFrame:
    """The one row of ``group_measures`` over the whole frame."""
    return group_measures(df, [], **kw)
