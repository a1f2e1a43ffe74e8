"""Days, times and spans, with bad input as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(key: Column) -> Column:
    """Days since 1970-01-01 of a strict YYYY-MM-DD, else null."""
    return F.when(key.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.datediff(F.try_to_date(key, "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")))


def day_key(n: Column) -> Column:
    return F.date_from_unix_date(n.cast("int")).cast("string")


def weekday(n: Column) -> Column:
    """0 is Sunday."""
    return F.pmod(n + 4, F.lit(7))


def time_ms(v: Column) -> Column:
    """Milliseconds, digits as text, or an ISO time."""
    return F.coalesce(v.try_cast("long"), F.unix_millis(F.try_to_timestamp(v)))


def span(ms: Column) -> tuple[Column, Column]:
    """A number and its unit, for people."""
    m = F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)).cast("double")
    r = lambda x: F.floor(x + 0.5)
    days = r(m / 86400000)
    n = F.when(m < 3600000, F.greatest(F.lit(1), r(m / 60000))).when(m < 86400000, r(m / 3600000)).when(days < 30, days).when(days < 365, r(days / 30)).otherwise(r(days / 365 * 10) / 10)
    unit = F.when(m < 3600000, "min").when(m < 86400000, "hour").when(days < 30, "day").when(days < 365, "month").otherwise("year")
    return n.cast("double"), unit


def study_days(first: Column, exam: Column, weekdays: list[int], reserve: int = 0) -> Column:
    """Days from the first to before the exam that fall on the weekdays (0 is Sunday), less the reserve; numbers of days."""
    full = F.floor((exam - first) / 7)
    rest = (exam - first) - full * 7
    n = full * len(set(weekdays)) + sum((F.when(F.pmod(F.lit(w) - weekday(first), F.lit(7)) < rest, 1).otherwise(0) for w in sorted(set(weekdays))), F.lit(0))
    return F.when(exam > first, F.greatest(F.lit(0), n - reserve)).otherwise(0).cast("long")


def label(day: Column) -> Column:
    """A date in words, as blogs show it; what is no date stays as it is, nothing is empty."""
    at = day.try_cast("date")
    return F.coalesce(F.when(at.isNotNull(), F.date_format(at, "yyyy'년' M'월' d'일'")), day, F.lit(""))
