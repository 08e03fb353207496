"""Filter specs and grid predicates (F1-F8) as Catalyst ``Column`` objects.

Equality filters on plain columns reach the Parquet scan as
``PushedFilters``; apply them *before* any rollup, since a filter above
``Expand`` is not pushed down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.schema import DIMS, MEASURES, TEXT_COLUMNS, spec_column


@dataclass(frozen=True)
class LedgerFilter:
    """AND of equalities on the four levels; unset (None / '') means "any"."""

    txn_date: str | None = None
    entity_type: str | None = None
    entity_sub_type: str | None = None
    entity_name: str | None = None

    @classmethod
    def of(cls, spec: LedgerFilter | Mapping[str, str | None] | None) -> LedgerFilter:
        """Build from a dict using snake_case keys or display labels.

        Unknown keys raise instead of being ignored.
        """
        if spec is None:
            return cls()
        if isinstance(spec, LedgerFilter):
            return spec
        values: dict[str, str | None] = {}
        for key, value in spec.items():
            # Levels are text; a date object becomes its ISO text.
            values[spec_column(key)] = None if value is None or value == "" else str(value)
        return cls(**values)

    def items(self) -> list[tuple[str, str]]:
        """The set keys, outermost level first."""
        return [(c, getattr(self, c)) for c in DIMS if getattr(self, c)]

    def predicate(self, columns: Sequence[str] = ()) -> Column:
        """The AND of equalities. On a month-partitioned saved ledger
        (``txn_month`` present) a date also fixes its month, so the scan
        prunes every other month directory."""
        cond = F.lit(True)
        for c, v in self.items():
            cond = cond & (F.col(c) == F.lit(v))
            if c == "txn_date" and "txn_month" in columns:
                cond = cond & (F.col("txn_month") == F.lit(v[:7]))
        return cond

    def start_level(self) -> int:
        """First level whose key is unset; 4 when every level is set."""
        for i, c in enumerate(DIMS):
            if not getattr(self, c):
                return i
        return len(DIMS)

    def is_empty(self) -> bool:
        return not self.items()


def path_filter(path: list[str] | tuple[str, ...]) -> LedgerFilter:
    """Filter for the node reached by following ``path`` from the root."""
    if len(path) > len(DIMS):
        raise ValueError(f"path deeper than {len(DIMS)} levels: {path!r}")
    return LedgerFilter.of(dict(zip(DIMS, path)))


# Operator names accepted by the grid filters.
TEXT_OPS = ["contains", "not_contains", "equals", "not_equal", "starts_with", "ends_with", "blank", "not_blank"]
NUMBER_OPS = ["eq", "ne", "lt", "le", "gt", "ge", "between"]


def text_predicate(column: str, op: str, value: str | None = None) -> Column:
    """Case-insensitive text condition on one of the six text columns."""
    if column not in TEXT_COLUMNS + ["txn_date"]:
        raise ValueError(f"not a text column: {column!r}")
    if op not in TEXT_OPS:
        raise ValueError(f"unknown text op {op!r}; expected one of {TEXT_OPS}")
    c = F.lower(F.col(column))
    v = F.lit(("" if value is None else str(value)).lower())
    if op == "contains":
        return c.contains(v)
    if op == "not_contains":
        return ~c.contains(v)
    if op == "equals":
        return c == v
    if op == "not_equal":
        return c != v
    if op == "starts_with":
        return c.startswith(v)
    if op == "ends_with":
        return c.endswith(v)
    if op == "blank":
        return F.col(column).isNull() | (F.col(column) == "")
    if op == "not_blank":
        return F.col(column).isNotNull() & (F.col(column) != "")
    raise ValueError(f"unknown text op {op!r}; expected one of {TEXT_OPS}")


def number_predicate(column: str, op: str, value: float, value2: float | None = None) -> Column:
    """Numeric condition on one of the four measures."""
    if column not in MEASURES:
        raise ValueError(f"not a measure: {column!r}")
    if op not in NUMBER_OPS:
        raise ValueError(f"unknown number op {op!r}; expected one of {NUMBER_OPS}")
    c = F.col(column)
    if op == "eq":
        return c == value
    if op == "ne":
        return c != value
    if op == "lt":
        return c < value
    if op == "le":
        return c <= value
    if op == "gt":
        return c > value
    if op == "ge":
        return c >= value
    if op == "between":
        if value2 is None:
            raise ValueError("between needs two values")
        return c.between(value, value2)
    raise ValueError(f"unknown number op {op!r}; expected one of {NUMBER_OPS}")


@dataclass(frozen=True)
class GridFilter:
    """Per-column grid conditions, ANDed: ``[(column, op, value[, value2]), ...]``."""

    conditions: tuple = field(default_factory=tuple)

    def predicate(self) -> Column:
        cond = F.lit(True)
        for cnd in self.conditions:
            column, op, *vals = cnd
            if column in MEASURES:
                cond = cond & number_predicate(column, op, *vals)
            else:
                cond = cond & text_predicate(column, op, *vals)
        return cond
