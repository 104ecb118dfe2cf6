"""Number helpers whose results have to be equal wherever a value is written and read again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half-even rounding of the exact binary value: by decimal format, since ``round`` works on the shortest decimal."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * places)).cast("double") + F.lit(0.0)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """``a / b``, and ``otherwise`` where b is 0 or null."""
    safe = F.try_divide(a.cast("double"), b.cast("double"))
    return safe if otherwise is None else F.coalesce(safe, F.lit(otherwise))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, as_column(low)), as_column(high))


def nearest_int(x: Column) -> Column:
    """Half-even, as an int."""
    return F.rint(x).cast("int")


def blank_to_null(x: Column) -> Column:
    """Empty strings count as missing."""
    return F.when(x != "", x)
