"""Publication calendar: weekdays that are not holidays, the last of them before a day or a time, and how many lie between two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_publish_day(d: Column, holidays: list[str]) -> Column:
    """Whether prices are published for a day: no weekend, no holiday."""
    return F.dayofweek(d).between(2, 6) & ~d.isin(*[F.lit(h).cast("date") for h in holidays])


def prev_publish_day(d: Column, holidays: list[str], longest: int = 30) -> Column:
    """The last publication day before d; null if there is none within `longest` days."""
    back = F.sequence(F.date_sub(d, 1), F.date_sub(d, longest), F.expr("INTERVAL -1 DAY"))
    return F.get(F.filter(back, lambda x: is_publish_day(x, holidays)), F.lit(0))


def expected_latest(now: Column, holidays: list[str], cutoff_hour: int = 23) -> Column:
    """The newest day whose prices can be out at a time: that day itself from the cutoff on, if it is a publication day, else the one before."""
    day = F.to_date(now)
    return F.when((F.hour(now) >= cutoff_hour) & is_publish_day(day, holidays), day).otherwise(prev_publish_day(day, holidays))


def publish_days_between(last: Column, expected: Column, holidays: list[str]) -> Column:
    """Publication days after `last` up to `expected`; 0 if that is no later."""
    days = F.when(expected > last, F.sequence(F.date_add(last, 1), expected, F.expr("INTERVAL 1 DAY"))).otherwise(F.array().cast("array<date>"))
    return F.when(last.isNotNull() & expected.isNotNull(), F.size(F.filter(days, lambda x: is_publish_day(x, holidays))))


def freshness(age: Column) -> Column:
    """Class of a series by publication days since its last point."""
    return F.when(age.isNull(), "no_history").when(age <= 0, "current").when(age <= 1, "lag1").when(age <= 6, "stale_recent").when(age < 45, "stale_deep").otherwise("dead_suspect")
