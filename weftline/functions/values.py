"""Column functions over typed values: dates, numbers, comparisons, penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in this order; a month or a year alone is its first day.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy-M", "yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy")


def date_value(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS])


def number_value(c: Column) -> Column:
    """Null where it isn't a plain number; NaN and infinities aren't."""
    return c.cast("string").try_cast("decimal(38,18)")


def earlier(a: Column, b: Column) -> Column:
    return date_value(a) < date_value(b)


def later(a: Column, b: Column) -> Column:
    return date_value(a) > date_value(b)


younger, older = later, earlier


def _floating(a: Column, b: Column) -> Column:
    """Whether both are of number types and one is a float or double: known from the types, whatever the values."""
    number = lambda c: F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    float_ = lambda c: F.typeof(c).isin("float", "double")
    return number(a) & number(b) & (float_(a) | float_(b))


def compare(a: Column, b: Column, how: str) -> Column:
    """EQ and NE compare the values as they are; orders compare numbers where both are, else dates.

    Floats and doubles are compared in their own type, which has values that no decimal holds; NaN is the largest there, as in sorts.
    """
    how = {"EQUAL": "EQ", "=": "EQ", "==": "EQ", "NEQ": "NE", "!=": "NE", "NOT_EQUAL": "NE", "<": "LT", "EARLIER": "LT", "BEFORE": "LT", ">": "GT", "LATER": "GT", "AFTER": "GT", "<=": "LE", "LTE": "LE", ">=": "GE", "GTE": "GE"}.get(how.upper(), how.upper())
    if how not in ("EQ", "NE", "LT", "GT", "LE", "GE"):
        raise ValueError(f"unsupported comparison: {how}")
    same = a.eqNullSafe(b)
    if how == "EQ":
        return same
    if how == "NE":
        return ~same
    x, y = number_value(a), number_value(b)
    both = x.isNotNull() & y.isNotNull()
    less = F.when(_floating(a, b), a < b).when(both, x < y).otherwise(earlier(a, b))
    more = F.when(_floating(a, b), a > b).when(both, x > y).otherwise(later(a, b))
    return {"LT": less, "GT": more, "LE": F.when(same, True).otherwise(less), "GE": F.when(same, True).otherwise(more)}[how]


def order_key(c: Column) -> Column:
    """Sort key of mixed values: numbers, then dates, then texts."""
    number, date = number_value(c), date_value(c)
    return F.struct(F.when(number.isNotNull(), 0).when(date.isNotNull(), 1).otherwise(2).alias("kind"), number.alias("number"), date.alias("date"), F.lower(c.cast("string")).alias("text"))


def kl_penalty(log_p: Column, ref_log_p: Column, kind: str) -> Column:
    diff = log_p - ref_log_p
    if kind == "kl":
        return diff
    if kind == "abs":
        return F.abs(diff)
    if kind == "mse":
        return 0.5 * diff * diff
    if kind == "low_var_kl":
        return F.greatest(F.least(F.exp(-diff) + diff - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"unsupported penalty: {kind}")


def adaptive_kl(beta: float, kl: float, target: float, horizon: int, n: int) -> float:
    """The next coefficient of the adaptive controller."""
    error = min(max(kl / target - 1, -0.2), 0.2)
    return beta * (1 + error * n / horizon)


def overlong_penalty(length: Column, allowed: int, buffer: int, factor: float) -> Column:
    """Negative in proportion to how far a response goes into the buffer before its allowed length."""
    return F.least(-(length - (allowed - buffer)) / buffer * factor, F.lit(0.0))
