"""Amount rendering as pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit followed by pairs of digits then one digit and the decimal point:
# insert a comma after it (Indian grouping 12,34,567.00).
_INR_GROUPS = r"(\d)(?=(\d\d)+\d\.)"


def format_inr(c: Column) -> Column:
    """Two decimals with Indian digit grouping; null -> ``0.00``."""
    fixed = F.format_string("%.2f", F.coalesce(c.cast("double"), F.lit(0.0)))
    return F.regexp_replace(fixed, _INR_GROUPS, "$1,")


def format_amount(c: Column) -> Column:
    """``#,##0.00`` (thousands grouping, two decimals)."""
    return F.format_number(F.coalesce(c.cast("double"), F.lit(0.0)), 2)
