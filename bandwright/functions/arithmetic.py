"""Column arithmetic with the rules of IEEE 754 where Spark's ANSI mode would raise."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """a / b; a zero divisor gives NaN, or infinity with the sign of a."""
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def doubles(values: list[float]) -> Column:
    """An array literal of doubles."""
    return F.array(*(F.lit(float(v)) for v in values))


def tidy(x: Column, digits: int) -> Column:
    """Rounded, with negative zero made zero."""
    return F.round(x, digits) + F.lit(0.0)
