"""Dates as days; every clock takes its day as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written forms of no date.
NO_DATE = ("", "n/a", "na", "none", "-", "\u2014", "pending", "tbd")


def us_date(text: Column, fallback_year: Column | None = None) -> Column:
    """M/D[/YY[YY]] or M-D or M.D; without a year, the fallback's. Null where it is no day."""
    p = F.split(F.btrim(text), r"[/.\-]")
    year = F.get(p, 2)
    full = F.when(year.isNull(), fallback_year.cast("string") if fallback_year is not None else F.lit(None)).when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    iso = F.concat_ws("-", full, F.lpad(F.get(p, 0), 2, "0"), F.lpad(F.get(p, 1), 2, "0"))
    return F.try_to_date(iso, "yyyy-MM-dd")


def opt_date(text: Column) -> Column:
    """An ISO or US date; the written forms of no date are null."""
    t = F.lower(F.btrim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin(*NO_DATE), F.lit(None).cast("date")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")).otherwise(us_date(t))


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def age(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)


def day_range(day: Column, days: int) -> Column:
    """Number of the range of ``days`` days that a day lies in."""
    return F.floor(F.unix_date(day) / max(days, 1))


def near_days(day: Column, days: int) -> Column:
    """The ranges of days that are at most ``days`` away: a key for joins within a window."""
    return F.array(*[day_range(day, days) + i for i in (-1, 0, 1)])
