"""Arithmetic and elementary functions with IEEE results: no null and no error where a float is defined.

All are built-in expressions, so they stay in generated code.  Integer overflow and integer division by zero raise under
ANSI mode, which Spark has on by default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _d(x: Column | str | float) -> Column:
    return _c(x).cast("double")


def divide(x, y) -> Column:
    """Always a float; a zero divisor gives an infinity, or NaN for 0 / 0."""
    a, b = _d(x), _d(y)
    # 1 / -0.0 is negative: the sign of a zero shows in its text only
    negative_zero = b.cast("string").startswith("-")
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when((a > 0) != negative_zero, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def modulo(x, y) -> Column:
    """Float remainder with the sign of the dividend; NaN for a zero divisor or an infinite dividend."""
    a, b = _d(x), _d(y)
    return F.when(a.isNull() | b.isNull(), None).when((b == 0) | F.isnan(b) | ~is_finite(a), NAN).when(F.abs(b) == INF, a).otherwise(a % F.when(b != 0, b))


def power(x, y) -> Column:
    return F.pow(_d(x), _d(y))


def integer_div(x, y) -> Column:
    """Truncates toward zero; a zero divisor raises."""
    return F.call_function("div", _c(x).cast("bigint"), _c(y).cast("bigint"))


def integer_mod(x, y) -> Column:
    """Sign of the dividend; a zero divisor raises."""
    return _c(x).cast("bigint") % _c(y).cast("bigint")


def plus_text(x, y) -> Column:
    """Concatenation, where a missing operand reads NULL."""
    return F.concat(F.coalesce(_c(x).cast("string"), F.lit("NULL")), F.coalesce(_c(y).cast("string"), F.lit("NULL")))


def absolute(x) -> Column:
    return F.abs(_c(x))


def sign(x) -> Column:
    """-1, 0 or 1 in the type of a float argument."""
    v = _c(x)
    return F.when(F.isnan(v.cast("double")), v).otherwise(F.signum(v.cast("double")))


def ceil(x) -> Column:
    return _whole(x, F.ceil)


def floor(x) -> Column:
    return _whole(x, F.floor)


def _whole(x, f) -> Column:
    """Whole numbers as floats; floats beyond 2 ** 52 are whole already, and infinities and NaN stay."""
    v = _d(x)
    small = F.abs(v) < 2.0**52
    return F.when(small, f(F.when(small, v).otherwise(0.0)).cast("double")).otherwise(v)


def round_half_away(x) -> Column:
    v = _d(x)
    down = floor(F.abs(v))
    return F.when(F.abs(v) < 2.0**52, F.signum(v) * F.when(F.abs(v) - down >= 0.5, down + 1).otherwise(down)).otherwise(v)


def trunc(x) -> Column:
    v = _d(x)
    return F.when(v < 0, ceil(v)).otherwise(floor(v))


def _log(x, f) -> Column:
    v = _d(x)
    return F.when(v.isNull(), None).when(F.isnan(v) | (v < 0), NAN).when(v == 0, -INF).otherwise(f(F.when(v > 0, v)))


def log(x) -> Column:
    """NaN below zero, minus infinity at zero."""
    return _log(x, F.ln)


def log10(x) -> Column:
    return _log(x, F.log10)


def log2(x) -> Column:
    return _log(x, F.log2)


def exp(x) -> Column:
    return F.exp(_d(x))


def sqrt(x) -> Column:
    return F.sqrt(_d(x))


def _trigonometric(f):
    return lambda x: f(_d(x))


sin, cos, tan, asin, acos, atan = map(_trigonometric, (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan))


def atan2(x, y) -> Column:
    return F.atan2(_d(x), _d(y))


def is_nan(x) -> Column:
    return F.isnan(_d(x))


def is_infinite(x) -> Column:
    return F.abs(_d(x)) == INF


def is_finite(x) -> Column:
    return ~F.isnan(_d(x)) & (F.abs(_d(x)) < INF)


def is_close(x, y, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    """|x - y| <= atol + rtol |y|; infinities are close to themselves only."""
    a, b = _d(x), _d(y)
    nan = F.isnan(a) | F.isnan(b)
    return F.when(nan, F.isnan(a) & F.isnan(b) & F.lit(equal_nan)).when((F.abs(a) == INF) | (F.abs(b) == INF), a == b).otherwise(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))


def if_else(test, yes, no) -> Column:
    return F.when(_c(test), _c(yes)).otherwise(_c(no))


def pmax(x, y) -> Column:
    """The larger of two; NaN if either is."""
    return _extreme(x, y, F.greatest)


def pmin(x, y) -> Column:
    return _extreme(x, y, F.least)


def _extreme(x, y, f) -> Column:
    a, b = _c(x), _c(y)
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(nan, F.when(F.isnan(a.cast("double")), a).otherwise(b)).otherwise(f(a, b))


def all_of(*tests) -> Column:
    return reduce(lambda a, b: a & b, map(_c, tests))


def any_of(*tests) -> Column:
    return reduce(lambda a, b: a | b, map(_c, tests))
