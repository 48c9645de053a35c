"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 or 0 as int; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def mean_of(condition: Column) -> Column:
    """Share of rows for which a known condition holds."""
    return F.avg(condition.cast("int").cast("double"))


def r4(value: Column) -> Column:
    return F.round(value, 4)


def clip(value: Column, low: float, high: float) -> Column:
    """Within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def week_number(day: Column) -> Column:
    """Ordinal of the seven-day block since 1970-01-01."""
    return F.floor(F.unix_date(day) / 7).cast("int")


def week_of(stamp: Column) -> Column:
    return F.to_date(F.date_trunc("week", stamp))
