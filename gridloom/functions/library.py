"""Spreadsheet functions as Spark columns.

Everything is a composition of built-in column functions, so it stays inside code generation.
Out-of-domain arguments (division by zero, logarithm of zero) give null. Null arguments give null
unless a function says otherwise.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1899-12-30"  #: serial number 0 of dates from 1 March 1900 on


def _balanced(op: Callable[[Column, Column], Column], args: tuple[Column, ...]) -> Column:
    """A balanced tree of op, so that long argument lists stay shallow."""
    args = list(args)
    while len(args) > 1:
        args = [op(*args[i : i + 2]) if i + 1 < len(args) else args[i] for i in range(0, len(args), 2)]
    return args[0]


def num(c: Column) -> Column:
    return c.cast("double")


def truth(c: Column) -> Column:
    """A condition: numbers hold unless zero."""
    return c.cast("boolean")


# Arithmetic ---------------------------------------------------------------------------------


def add(*a: Column) -> Column:
    return _balanced(operator.add, tuple(map(num, a)))


def subtract(a: Column, b: Column) -> Column:
    return num(a) - num(b)


def multiply(*a: Column) -> Column:
    return _balanced(operator.mul, tuple(map(num, a)))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(num(a), num(b))


def power(a: Column, b: Column) -> Column:
    return F.pow(num(a), num(b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    a, b = num(a), num(b)
    return a - b * F.floor(F.try_divide(a, b))


def negate(a: Column) -> Column:
    return -num(a)


def percent(a: Column) -> Column:
    return num(a) / 100


def log(a: Column, base: Column | None = None) -> Column:
    return F.log10(num(a)) if base is None else F.try_divide(F.ln(num(a)), F.ln(num(base)))


#: 0! to 170!, the last that a double holds.
_FACTORIALS = [float(math.factorial(k)) for k in range(21)]
for _k in range(21, 171):
    _FACTORIALS.append(_FACTORIALS[-1] * _k)


def fact(n: Column) -> Column:
    """n! of the whole part; null below 0 and beyond 170."""
    n = F.floor(num(n))
    return F.when((n >= 0) & (n <= 170), F.get(F.lit(_FACTORIALS), n.cast("int")))


def combin(n: Column, k: Column) -> Column:
    n, k = F.floor(num(n)), F.floor(num(k))
    return F.when((k >= 0) & (k <= n), F.round(fact(n) / (fact(k) * fact(n - k)), 0))


def permut(n: Column, k: Column) -> Column:
    n, k = truncate(n), truncate(k)
    return F.when((k >= 0) & (k <= n), F.round(fact(n) / fact(n - k), 0))


# Rounding -----------------------------------------------------------------------------------


def _scaled(n: Column, digits: Column | None, how: Callable[[Column], Column]) -> Column:
    n = num(n)
    scale = F.lit(1.0) if digits is None else F.pow(F.lit(10.0), F.floor(num(digits)))
    return F.signum(n) * how(F.abs(n) * scale).cast("double") / scale


def round_half_away(n: Column, digits: Column | None = None) -> Column:
    return _scaled(n, digits, lambda x: F.floor(x + 0.5))


def round_down(n: Column, digits: Column | None = None) -> Column:
    return _scaled(n, digits, F.floor)


def round_up(n: Column, digits: Column | None = None) -> Column:
    return _scaled(n, digits, F.ceil)


truncate = round_down


def integer(n: Column) -> Column:
    return F.floor(num(n)).cast("double")


def ceiling(n: Column, significance: Column) -> Column:
    """To a multiple of the significance's size, away from zero."""
    n, s = num(n), F.abs(num(significance))
    return F.signum(n) * F.ceil(F.try_divide(F.abs(n), s)) * s


def floor_to(n: Column, significance: Column) -> Column:
    """To a multiple of the significance's size, toward zero."""
    n, s = num(n), F.abs(num(significance))
    return F.signum(n) * F.floor(F.try_divide(F.abs(n), s)) * s


def even(n: Column) -> Column:
    return ceiling(n, F.lit(2.0))


def odd(n: Column) -> Column:
    """The next odd number away from zero; of zero, one."""
    sign = F.when(num(n) < 0, F.lit(-1.0)).otherwise(1.0)
    return even(num(n) + sign) - sign


# Logic and text -----------------------------------------------------------------------------


def if_(condition: Column, a: Column, b: Column | None = None) -> Column:
    return F.when(truth(condition), a).otherwise(F.lit(False) if b is None else b)


def and_(*a: Column) -> Column:
    return _balanced(operator.and_, tuple(map(truth, a)))


def or_(*a: Column) -> Column:
    return _balanced(operator.or_, tuple(map(truth, a)))


def not_(a: Column) -> Column:
    return ~truth(a)


def text_equal(a: Column, b: Column) -> Column:
    """Equality of texts regardless of case."""
    return F.lower(a) == F.lower(b)


def concat(*a: Column) -> Column:
    return F.concat(*[x.cast("string") for x in a])


def is_na(a: Column) -> Column:
    return a.isNull()


def mid(t: Column, start: Column, n: Column) -> Column:
    return F.substring(t, start.cast("int"), n.cast("int"))


# Aggregates over arguments ------------------------------------------------------------------


def product(*a: Column) -> Column:
    return multiply(*a)


def minimum(*a: Column) -> Column:
    return F.least(*a) if len(a) > 1 else a[0]


def maximum(*a: Column) -> Column:
    return F.greatest(*a) if len(a) > 1 else a[0]


def average(*a: Column) -> Column:
    return add(*a) / len(a)


# Arrays (ArrayType columns) -----------------------------------------------------------------


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(num(x), F.lit(0.0)))


def array_product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * F.coalesce(num(x), F.lit(1.0)))


def array_count(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x.isNotNull())).cast("double")


def array_count_blank(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x.isNull())).cast("double")


def array_average(a: Column) -> Column:
    return F.try_divide(array_sum(a), array_count(a))


def _sorted(a: Column) -> Column:
    return F.array_sort(F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: x.cast("double")))


def array_percentile(a: Column, p: Column) -> Column:
    """The inclusive percentile with linear interpolation."""
    s = _sorted(a)
    at = (F.size(s) - 1) * num(p)
    low = F.floor(at).cast("int")
    lower, upper = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return F.when((num(p) >= 0) & (num(p) <= 1), lower + (at - low) * (upper - lower))


def array_median(a: Column) -> Column:
    return array_percentile(a, F.lit(0.5))


def array_mode(a: Column) -> Column:
    """The most frequent value, the first such; null if none repeats."""
    kept = F.filter(a, lambda x: x.isNotNull())
    counted = F.transform(kept, lambda x, i: F.struct(F.size(F.filter(kept, lambda y: y == x)).alias("n"), (-i).alias("at"), x.alias("v")))
    best = F.array_max(counted)
    return F.when(best["n"] > 1, best["v"].cast("double"))


def array_avedev(a: Column) -> Column:
    mean = array_average(a)
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(F.abs(num(x) - mean), F.lit(0.0))), array_count(a))


def array_percent_rank(a: Column, x: Column) -> Column:
    """The share of values below x, between neighbours by interpolation; null outside."""
    s, x = _sorted(a), num(x)
    below = F.size(F.filter(s, lambda v: v < x))
    here = F.size(F.filter(s, lambda v: v == x))
    lower, upper = F.get(s, below - 1), F.get(s, below)
    span = F.size(s) - 1
    return F.when((x >= F.get(s, F.lit(0))) & (x <= F.get(s, span)), F.when(here > 0, F.try_divide(below, span)).otherwise(F.try_divide(below - 1 + (x - lower) / (upper - lower), span)))


def array_filter(values: Column, mask: Column, default: Column) -> Column:
    """The values whose mask is true; the default alone if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(default))


def first_true(values: Column, mask: Column, default: Column) -> Column:
    """The first value whose mask is true, else the default."""
    return F.coalesce(F.get(F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"]), F.lit(0)), default)


def array_compare(a: Column, v: Column, op: Callable = operator.eq) -> Column:
    """A mask of an array against a scalar."""
    return F.transform(a, lambda x: op(x, v))


def array_mask_times(mask: Column, other: Column) -> Column:
    return F.zip_with(mask, other, lambda m, x: F.when(m, num(x)).otherwise(0.0))


def sum_product(*a: Column) -> Column:
    if len(a) == 1:
        return array_sum(a[0])
    return array_sum(functools.reduce(lambda p, q: F.zip_with(p, q, lambda x, y: num(x) * num(y)), a))


def match(v: Column, keys: Column, kind: int = 1) -> Column:
    """The 1-based place of v: exact (0), or the last key of an ascending array that is at most v (1)."""
    if kind == 0:
        return F.nullif(F.array_position(keys, v), F.lit(0).cast("long")).cast("double")
    # As many keys are above v as stand before it in descending order; a lambda would work v out once a key, uncompiled.
    above = F.array_position(F.sort_array(F.array_append(keys, v), asc=False), v) - 1
    nulls = F.array_position(F.sort_array(keys), F.array_min(keys)) - 1
    n = F.size(keys) - nulls - above
    return F.when(n > 0, n.cast("double"))


def index(values: Column, at: Column) -> Column:
    return F.get(values, at.cast("int") - 1)


def vlookup(v: Column, keys: Column, results: Column, approximate: bool = True) -> Column:
    return index(results, match(v, keys, 1 if approximate else 0))


def vector_lookup(v: Column, keys: Column, results: Column, approximate: Column) -> Column:
    return F.when(approximate, vlookup(v, keys, results)).otherwise(vlookup(v, keys, results, False))


# Dates --------------------------------------------------------------------------------------


def date_add(d: Column, n: Column) -> Column:
    """Whole days later; fractions go."""
    return F.date_add(d, truncate(n).cast("int"))


def date_sub(d: Column, n: Column) -> Column:
    return F.date_sub(d, truncate(n).cast("int"))


def eomonth(d: Column, n: Column) -> Column:
    return F.last_day(F.add_months(d, truncate(n).cast("int")))


def serial(d: Column) -> Column:
    """The serial number of a date, from 1 March 1900 on."""
    return F.datediff(d, F.lit(EPOCH).cast("date")).cast("double")


def from_serial(n: Column) -> Column:
    """The date of a serial number; before 1 March 1900 the fictitious leap day shifts it by one."""
    n = F.floor(num(n)).cast("int")
    return F.date_add(F.lit(EPOCH).cast("date"), n + F.when(n < 60, 1).otherwise(0))


def date(y: Column, m: Column, d: Column) -> Column:
    """The serial number of a year, month and day that may overflow; years below 1900 count from it."""
    y, m, d = (truncate(x).cast("int") for x in (y, m, d))
    year = F.when(y < 1900, y + 1900).otherwise(y)
    day = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), m - 1), d - 1)
    n = serial(day)
    return n - F.when(n < 61, 1).otherwise(0)


def year(n: Column) -> Column:
    return F.year(from_serial(n)).cast("double")


def month(n: Column) -> Column:
    return F.month(from_serial(n)).cast("double")


def day(n: Column) -> Column:
    return F.dayofmonth(from_serial(n)).cast("double")


def is_leap_year(y: Column) -> Column:
    """1 or 0; 1900 counts as a leap year, as serial numbers have it."""
    y = num(y)
    divides = lambda k: modulo(y, F.lit(float(k))) == 0
    return F.when((y == 1900) | divides(400) | (divides(4) & ~divides(100)), 1.0).otherwise(0.0)


def time(h: Column, m: Column, s: Column) -> Column:
    """The fraction of a day, unwrapped."""
    return num(h) / 24 + num(m) / 1440 + num(s) / 86400


def _seconds(t: Column) -> Column:
    """Seconds of the day, steadied against the last binary digits, of which late days have fewer below the second."""
    s = num(t) * 86400
    return modulo(F.floor(s + F.greatest(F.lit(1e-6), F.abs(s) * 2.0**-50)), F.lit(86400.0))


def hour(t: Column) -> Column:
    return F.floor(_seconds(t) / 3600).cast("double")


def minute(t: Column) -> Column:
    return F.floor(modulo(_seconds(t), F.lit(3600.0)) / 60).cast("double")


def second(t: Column) -> Column:
    return modulo(_seconds(t), F.lit(60.0))


def days360(start: Column, end: Column, european: Column | None = None, compat: bool = False) -> Column:
    """Days of a year of twelve 30-day months, between dates, by the published US or European rule.

    compat gives the US rule with its end-of-month branches the other way round.
    """
    d1, d2 = F.dayofmonth(start), F.dayofmonth(end)
    base = (F.year(end) - F.year(start)) * 360 + (F.month(end) - F.month(start)) * 30
    eu = base + F.least(d2, F.lit(30)) - F.least(d1, F.lit(30))
    month_end = start == F.last_day(start)
    first = F.when(month_end, 30).otherwise(F.least(d1, F.lit(30)))
    if compat:
        c1 = F.least(d1, F.lit(30))
        last = F.when((c1 == 28) & (F.month(start) == 2) & (d2 == 31), 31).when((d2 == 31) & (c1 < 30), 30).otherwise(d2)
    else:
        feb = month_end & (F.month(start) == 2) & (end == F.last_day(end)) & (F.month(end) == 2)
        last = F.when(feb, 30).when((d2 == 31) & (first >= 30), 30).otherwise(d2)
    us = base + last - first
    out = us if european is None else F.when(truth(european), eu).otherwise(us)
    return out.cast("double")


def yearfrac(start: Column, end: Column, basis: Column | None = None) -> Column:
    """Years between dates by day-count basis 0 (US 30/360), 1 (actual), 2 (360), 3 (365), 4 (EU 30/360)."""
    a, b = F.least(start, end), F.greatest(start, end)
    days = F.datediff(b, a)
    y1, y2, m1, m2 = F.year(a), F.year(b), F.month(a), F.month(b)
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    leap = lambda y: (y % 400 == 0) | ((y % 4 == 0) & (y % 100 != 0))
    within = (y2 == y1 + 1) & ((m2 < m1) | ((m2 == m1) & (d2 <= d1)))
    has_feb29 = (leap(y1) & (m1 < 3)) | (leap(y2) & ((m2 > 2) | ((m2 == 2) & (d2 == 29))))
    mean = F.datediff(F.make_date(y2 + 1, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(1), F.lit(1))) / (y2 - y1 + 1)
    actual = days / F.when(within, F.when(has_feb29, 366.0).otherwise(365.0)).otherwise(mean)
    basis = F.lit(0) if basis is None else F.floor(num(basis))
    return F.when(basis == 0, days360(a, b) / 360).when(basis == 1, actual).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, days360(a, b, F.lit(True)) / 360)


# Finance ------------------------------------------------------------------------------------


def _due(r: Column, kind: Column) -> Column:
    """1, or 1 + r where payments come at the start of a period."""
    return F.when(truth(kind), 1 + r).otherwise(F.lit(1.0))


def fv(rate: Column, nper: Column, pmt: Column, pv: Column | float = 0.0, kind: Column | float = 0.0) -> Column:
    r, n, p, v, k = (num(F.lit(x)) for x in (rate, nper, pmt, pv, kind))
    g = F.pow(1 + r, n)
    return F.when(r == 0, -v - p * n).otherwise(-v * g - F.try_divide(p, r) * (g - 1) * _due(r, k))


def pv(rate: Column, nper: Column, pmt: Column, fv: Column | float = 0.0, kind: Column | float = 0.0) -> Column:
    r, n, p, f, k = (num(F.lit(x)) for x in (rate, nper, pmt, fv, kind))
    g = F.pow(1 + r, -n)
    return F.when(r == 0, -f - p * n).otherwise(-f * g - F.try_divide(p, r) * (1 - g) * _due(r, k))


def pmt(rate: Column, nper: Column, pv: Column, fv: Column | float = 0.0, kind: Column | float = 0.0) -> Column:
    r, n, v, f, k = (num(F.lit(x)) for x in (rate, nper, pv, fv, kind))
    g = F.pow(1 + r, n)
    return F.when(r == 0, F.try_divide(-(v + f), n)).otherwise(F.try_divide(-(v * g + f) * r, (g - 1) * _due(r, k)))


def ipmt(rate: Column, per: Column, nper: Column, pv: Column, fv_: Column | float = 0.0, kind: Column | float = 0.0) -> Column:
    """The interest part of payment number per; of a first payment at the start it is zero."""
    r, k = num(F.lit(rate)), num(F.lit(kind))
    payment = pmt(rate, nper, pv, fv_, kind)
    start = F.when(truth(k), num(F.lit(per)) - 2).otherwise(num(F.lit(per)) - 1)
    balance = fv(r, start, payment, pv, kind) - F.when(truth(k), payment).otherwise(0.0)
    return F.when(truth(k) & (num(F.lit(per)) == 1), 0.0).otherwise(balance * r)


def ppmt(rate: Column, per: Column, nper: Column, pv: Column, fv_: Column | float = 0.0, kind: Column | float = 0.0) -> Column:
    return pmt(rate, nper, pv, fv_, kind) - ipmt(rate, per, nper, pv, fv_, kind)


def nper(rate: Column, pmt: Column, pv: Column, fv: Column | float = 0.0, kind: Column | float = 0.0) -> Column:
    r, p, v, f, k = (num(F.lit(x)) for x in (rate, pmt, pv, fv, kind))
    d = _due(r, k)
    return F.when(r == 0, F.try_divide(-(v + f), p)).otherwise(F.try_divide(F.ln(F.try_divide(p * d - f * r, v * r + p * d)), F.ln(1 + r)))


def npv(rate: Column, *flows: Column) -> Column:
    r = num(rate)
    return add(*[num(f) / F.pow(1 + r, F.lit(float(i + 1))) for i, f in enumerate(flows)])


def sln(cost: Column, salvage: Column, life: Column) -> Column:
    return F.try_divide(num(cost) - num(salvage), num(life))


def syd(cost: Column, salvage: Column, life: Column, per: Column) -> Column:
    n = num(life)
    return F.try_divide((num(cost) - num(salvage)) * (n - num(per) + 1) * 2, n * (n + 1))


# Statistics ---------------------------------------------------------------------------------


def fisher(x: Column) -> Column:
    return 0.5 * F.ln(F.try_divide(1 + num(x), 1 - num(x)))


def fisher_inverse(y: Column) -> Column:
    return F.tanh(num(y))


_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Lowest power first."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def norm_s_dist(z: Column) -> Column:
    """The standard normal distribution, by a rational approximation of the complementary error function."""
    z = num(z)
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    tail = t * F.exp(-x * x + _horner(t, _ERFC)) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


_A = (2.50662827745924, -30.6647980661472, 138.357751867269, -275.928510446969, 220.946098424521, -39.6968302866538)
_B = (1.0, -13.2806815528857, 66.8013118877197, -155.698979859887, 161.585836858041, -54.4760987982241)
_C = (2.93816398269878, 4.37466414146497, -2.54973253934373, -2.40075827716184, -0.322396458041136, -7.78489400243029e-3)
_D = (1.0, 3.75440866190742, 2.445134137143, 0.32246712907004, 7.78469570904146e-3)


def norm_s_inv(p: Column) -> Column:
    """The inverse of the standard normal distribution; null outside 0 to 1."""
    p = num(p)

    def tail(x: Column) -> Column:
        q = F.sqrt(-2 * F.ln(x))
        return _horner(q, _C) / _horner(q, _D)

    q = p - 0.5
    centre = _horner(q * q, _A) * q / _horner(q * q, _B)
    inside = F.when(p < 0.02425, tail(p)).when(p > 0.97575, -tail(1 - p)).otherwise(centre)
    return F.when((p > 0) & (p < 1), inside)
