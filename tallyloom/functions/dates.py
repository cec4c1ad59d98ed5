"""Date helpers: period labels, weekday order, year ranges that prune."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import as_col

# Weekday order used to sort day names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def month_label(c: Column | str) -> Column:
    """'yyyy-MM' period label."""
    return F.date_format(as_col(c), "yyyy-MM")


def quarter_label(c: Column | str) -> Column:
    """'yyyyQn' period label."""
    c = as_col(c)
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def period_label(c: Column | str, grain: str) -> Column:
    if grain == "month":
        return month_label(c)
    if grain == "quarter":
        return quarter_label(c)
    raise ValueError(f"unknown grain {grain!r}")


def day_name(c: Column | str) -> Column:
    """Full English weekday name ('Monday')."""
    return F.date_format(as_col(c), "EEEE")


def weekday_rank(day_col: Column | str) -> Column:
    """1 for Monday .. 7 for Sunday, from a day-name column."""
    return F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), as_col(day_col))


def year_ranges(years: Iterable[int]) -> list[tuple[_dt.date, _dt.date]]:
    """Merge years into [start, end) date ranges (contiguous years merge)."""
    ys = sorted(set(int(y) for y in years))
    out: list[tuple[int, int]] = []
    for y in ys:
        if out and out[-1][1] == y:
            out[-1] = (out[-1][0], y + 1)
        else:
            out.append((y, y + 1))
    return [(_dt.date(a, 1, 1), _dt.date(b, 1, 1)) for a, b in out]


def in_years(c: Column | str, years: Iterable[int]) -> Column:
    """``year(c) IN years`` written as range predicates so scans can prune."""
    c = as_col(c)
    pred = None
    for lo, hi in year_ranges(years):
        p = (c >= F.lit(lo)) & (c < F.lit(hi))
        pred = p if pred is None else (pred | p)
    return pred if pred is not None else F.lit(False)


def year_at_most(c: Column | str, year: int) -> Column:
    """``year(c) <= year`` as a range predicate."""
    return as_col(c) < F.lit(_dt.date(int(year) + 1, 1, 1))


def to_date_lit(d) -> Column:
    if isinstance(d, (_dt.date, _dt.datetime)):
        return F.lit(d if not isinstance(d, _dt.datetime) else d.date())
    return F.lit(str(d)).cast("date")
