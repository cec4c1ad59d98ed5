"""Numeric conventions shared by all plans.

Money is summed as DECIMAL(28,8): the source system keeps money as DECIMAL, so
its sums are exact, and exact sums do not depend on how rows were partitioned or
shuffled (float sums do). Results leave as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(28, 8)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    return as_col(c).cast(MONEY)


def money_sum(c: Column | str, scale: int = 4) -> Column:
    """Exact decimal sum, rounded to ``scale`` and returned as DOUBLE."""
    return F.round(F.sum(money(c)), scale).cast("double")


def money_avg(c: Column | str, scale: int = 6) -> Column:
    """Mean of a money column: exact sum / count, rounded."""
    return F.round(F.try_divide(F.sum(money(c)).cast("double"), F.count(as_col(c))), scale)


def ratio(num: Column, den: Column, scale: int | None = 6) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL (ANSI-safe)."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return F.round(r, scale) if scale is not None else r
