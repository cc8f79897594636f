"""Spreadsheet functions as formulas of a small base: a library of macros for rule sets.

Each may stand for the engine's native column (``RuleSet.use_macro``) or stay unused beside it.
LN and LOG10 are made of each other, so at least one of them stays native.
"""

from __future__ import annotations

from ..plans.graph import NUMBER, from_formulas
from ..plans.registry import RuleSet

_SIGN = "IF({0} < 0, -1, 1)"
_MONTHS = "{1, 0, 0; 2, 31, 31; 3, 59, 60; 4, 90, 91; 5, 120, 121; 6, 151, 152; 7, 181, 182; 8, 212, 213; 9, 243, 244; 10, 273, 274; 11, 304, 305; 12, 334, 335}"
_GROWN = "(1 + rate) ^ nper"
_DUE = "IF(type = 1, 1 + rate, 1)"

#: name: (inputs, formula)
FORMULAS: dict[str, tuple[str, str]] = {
    "ABS": ("x", "IF(x < 0, -x, x)"),
    "CEILING": ("x s", _SIGN.format("x") + " * -INT(-ABS(x) / ABS(s)) * ABS(s)"),
    "FLOOR": ("x s", _SIGN.format("x") + " * INT(ABS(x) / ABS(s)) * ABS(s)"),
    "EVEN": ("x", "CEILING(x, 2)"),
    "ODD": ("x", _SIGN.format("x") + " * (CEILING(ABS(x) + 1, 2) - 1)"),
    "INT": ("x", "TRUNC(x) - IF(x < TRUNC(x), 1, 0)"),
    "TRUNC": ("x d", "ROUNDDOWN(x, d)"),
    "MOD": ("a b", "a - b * INT(a / b)"),
    "ROUND": ("x d", _SIGN.format("x") + " * INT(ABS(x) * 10 ^ d + 0.5) / 10 ^ d"),
    "ROUNDDOWN": ("x d", _SIGN.format("x") + " * INT(ABS(x) * 10 ^ d) / 10 ^ d"),
    "ROUNDUP": ("x d", _SIGN.format("x") + " * -INT(-ABS(x) * 10 ^ d) / 10 ^ d"),
    "COMBIN": ("n k", "FACT(n) / (FACT(k) * FACT(n - k))"),
    "PERMUT": ("n k", "FACT(n) / FACT(n - k)"),
    "EXP": ("x", "2.718281828459045 ^ x"),
    "LN": ("x", "LOG10(x) / 0.4342944819032518"),
    "LOG10": ("x", "LN(x) / 2.302585092994046"),
    "FISHER": ("x", "LN((1 + x) / (1 - x)) / 2"),
    "FISHERINV": ("y", "(EXP(2 * y) - 1) / (EXP(2 * y) + 1)"),
    "NORMSDIST": ("z", "1 / (1 + EXP(-1.5957691216057308 * z - 0.07135481282800768 * z ^ 3))"),
    "NORMSINV": ("p", "IF(p < 0.5, -1, 1) * (SQRT(-2 * LN(IF(p < 0.5, p, 1 - p))) - (2.515517 + 0.802853 * SQRT(-2 * LN(IF(p < 0.5, p, 1 - p))) - 0.020656 * LN(IF(p < 0.5, p, 1 - p))) / (1 + 1.432788 * SQRT(-2 * LN(IF(p < 0.5, p, 1 - p))) - 0.378538 * LN(IF(p < 0.5, p, 1 - p)) + 0.001308 * SQRT(-2 * LN(IF(p < 0.5, p, 1 - p))) ^ 3))"),
    "ISLEAPYEAR": ("y", "IF(OR(MOD(y, 400) = 0, AND(MOD(y, 4) = 0, MOD(y, 100) > 0), y = 1900), 1, 0)"),
    "DATE": ("y m d", f"365 * (y - 1900) + INT((y - 1901) / 4) - INT((y - 1901) / 100) + INT((y - 1601) / 400) + 1 + VLOOKUP(m, {_MONTHS}, 2 + ISLEAPYEAR(y), FALSE) + d"),
    "YEAR": ("s", "1900 + INT((s - 1.5) / 365.25) + IF(s >= DATE(1901 + INT((s - 1.5) / 365.25), 1, 1), 1, 0)"),
    "MONTH": ("s", f"IF(ISLEAPYEAR(YEAR(s)) = 1, LOOKUP(INT(s) - DATE(YEAR(s), 1, 1), {{0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335}}, {{1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12}}), LOOKUP(INT(s) - DATE(YEAR(s), 1, 1), {{0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334}}, {{1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12}}))"),
    "DAY": ("s", "INT(s) - DATE(YEAR(s), MONTH(s), 1) + 1"),
    "TIME": ("h m s", "SUM({h, m / 60, s / 3600}) / 24"),
    "HOUR": ("t", "MOD(INT(MOD(t, 1) * 86400 + 0.5) / 3600 - MOD(INT(MOD(t, 1) * 86400 + 0.5) / 3600, 1), 24)"),
    "MINUTE": ("t", "INT(MOD(INT(MOD(t, 1) * 86400 + 0.5), 3600) / 60)"),
    "SECOND": ("t", "MOD(INT(MOD(t, 1) * 86400 + 0.5), 60)"),
    "DAYS360": ("a b method", "360 * (YEAR(b) - YEAR(a)) + 30 * (MONTH(b) - MONTH(a)) + MIN(DAY(b), 30) - MIN(DAY(a), 30)"),
    "YEARFRAC": ("a b basis", "ABS(b - a) / IF(basis = 2, 360, 365)"),
    "FV": ("rate nper pmt pv type", f"IF(rate = 0, -pv - pmt * nper, -pv * {_GROWN} - pmt / rate * ({_GROWN} - 1) * {_DUE})"),
    "PV": ("rate nper pmt fv type", f"IF(rate = 0, -fv - pmt * nper, -fv / {_GROWN} - pmt / rate * (1 - 1 / {_GROWN}) * {_DUE})"),
    "PMT": ("rate nper pv fv type", f"IF(rate = 0, -(pv + fv) / nper, -(pv * {_GROWN} + fv) * rate / (({_GROWN} - 1) * {_DUE}))"),
    "IPMT": ("rate per nper pv fv type", "IF(AND(type = 1, per = 1), 0, (FV(rate, per - 1 - type, PMT(rate, nper, pv, fv, type), pv, type) - IF(type = 1, PMT(rate, nper, pv, fv, type), 0)) * rate)"),
    "PPMT": ("rate per nper pv fv type", "PMT(rate, nper, pv, fv, type) - IPMT(rate, per, nper, pv, fv, type)"),
    "NPER": ("rate pmt pv fv type", f"LOG((pmt * {_DUE} - fv * rate) / (pv * rate + pmt * {_DUE}), 10) / LOG(1 + rate, 10)"),
    "SLN": ("cost salvage life", "(cost - salvage) / life"),
    "SYD": ("cost salvage life per", "(cost - salvage) * (life - per + 1) * 2 / (life * (life + 1))"),
}


def library() -> RuleSet:
    """All macros, none of them in use."""
    rules = RuleSet()
    for name, (inputs, formula) in FORMULAS.items():
        rules.add_macro(name, from_formulas({name.lower(): formula}, name, dict.fromkeys(inputs.split(), NUMBER)), active=False)
    return rules
