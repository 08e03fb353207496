"""Grid filters (F7, F8): every text and number operator on the six rows."""

import pytest

from ledgerlake import grid_filter

TEXT_CASES = [
    (("entity_name", "contains", "corp"), {"ABC Corp"}),
    (("entity_name", "not_contains", "corp"), {"XYZ Ltd", "DEF Services", "GHI Inc", "Bank of Test"}),
    (("entity_name", "equals", "abc corp"), {"ABC Corp"}),
    (("entity_name", "not_equal", "abc corp"), {"XYZ Ltd", "DEF Services", "GHI Inc", "Bank of Test"}),
    (("entity_name", "starts_with", "d"), {"DEF Services"}),
    (("entity_name", "ends_with", "INC"), {"GHI Inc"}),
    (("particulars", "blank"), set()),
    (("particulars", "not_blank"), {"ABC Corp", "XYZ Ltd", "DEF Services", "GHI Inc", "Bank of Test"}),
]
NUMBER_CASES = [
    (("cash_dr", "eq", 5000.0), 1),
    (("cash_dr", "ne", 0.0), 2),
    (("cash_cr", "lt", 2500.0), 5),
    (("cash_cr", "le", 2000.0), 5),
    (("bank_dr", "gt", 500.0), 1),
    (("bank_dr", "ge", 500.0), 2),
    (("cash_dr", "between", 1000.0, 10000.0), 2),
]


@pytest.mark.parametrize("cond,names", TEXT_CASES)
def test_text_ops(six, cond, names):
    assert {r["entity_name"] for r in grid_filter(six, cond).collect()} == names


@pytest.mark.parametrize("cond,count", NUMBER_CASES)
def test_number_ops(six, cond, count):
    assert grid_filter(six, cond).count() == count


def test_conditions_are_anded(six):
    out = grid_filter(six, ("entity_type", "equals", "customer"), ("cash_dr", "gt", 6000.0)).collect()
    assert [r["particulars"] for r in out] == ["Payment received"]


def test_bad_ops_raise(six):
    with pytest.raises(ValueError):
        grid_filter(six, ("entity_name", "like", "x"))
    with pytest.raises(ValueError):
        grid_filter(six, ("cash_dr", "between", 1.0))
    with pytest.raises(ValueError):
        grid_filter(six, ("entity_name", "gt", 1.0))
