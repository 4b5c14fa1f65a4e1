"""Calendar buckets, intervention dummies and bank holidays.

All buckets go through DATE, so results do not depend on the session time zone when the
timestamps carry none.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekband.schema import monday

WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
SHIFTS = ("Early", "Daytime", "Evening", "Late")


def week_of(ts: Column) -> Column:
    """Monday of the ISO week."""
    return F.trunc(ts.cast("date"), "week")


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def year_of(ts: Column) -> Column:
    return F.year(ts.cast("date"))


def weekday_label(ts: Column) -> Column:
    """Three-letter weekday, Sunday first in `WEEKDAYS`."""
    day = ts.cast("date")
    labels = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.when(day.isNotNull(), F.element_at(labels, F.dayofweek(day)))


def shift_band(ts: Column) -> Column:
    """Shift that an hour falls in: 5-11 Early, 11-17 Daytime, 17-23 Evening, else Late."""
    hour = F.hour(ts)
    return (
        F.when(hour.isNull(), F.lit(None))
        .when(hour.between(5, 10), "Early")
        .when(hour.between(11, 16), "Daytime")
        .when(hour.between(17, 22), "Evening")
        .otherwise("Late")
    )


def since_day(ts: Column, day: dt.date) -> Column:
    """0 before `day`, 1 from it on, NULL for NULL."""
    d = ts.cast("date")
    return F.when(d < F.lit(day), 0).when(d >= F.lit(day), 1)


def after_week_of(week: Column, day: dt.date) -> Column:
    """True from the week that follows the week of `day`."""
    return week > F.lit(monday(day))


def period(
    ts: Column,
    cutoff: dt.date,
    before: str = "Pre-COVID",
    after: str = "2020",
    include_cutoff: bool = False,
) -> Column:
    """Label by midnight of the cutoff; `include_cutoff` puts midnight itself before it."""
    stamp, edge = ts.cast("timestamp_ntz"), F.lit(cutoff).cast("timestamp_ntz")
    early = stamp <= edge if include_cutoff else stamp < edge
    return F.when(stamp.isNull(), F.lit(None)).when(early, before).otherwise(after)


def is_holiday_week(week: Column, years: Iterable[int]) -> Column:
    """True in a week that contains a London bank holiday of `years`.

    A few dozen literals at most, so a membership test stays inside the projection.
    """
    return week.isin(sorted({monday(d) for d in london_holidays(years)}))


# One-off bank holidays, and regular ones moved to another day.
EXTRA_HOLIDAYS = {
    1999: [dt.date(1999, 12, 31)],
    2002: [dt.date(2002, 6, 3)],
    2011: [dt.date(2011, 4, 29)],
    2012: [dt.date(2012, 6, 5)],
}
MOVED_HOLIDAYS = {
    dt.date(1995, 5, 1): dt.date(1995, 5, 8),
    dt.date(2002, 5, 27): dt.date(2002, 6, 4),
    dt.date(2012, 5, 28): dt.date(2012, 6, 4),
    dt.date(2020, 5, 4): dt.date(2020, 5, 8),
}


def london_holidays(years: Iterable[int]) -> list[dt.date]:
    """Bank holidays of England by rule, with substitute days for weekends."""
    days: list[dt.date] = []
    for year in years:
        easter = easter_sunday(year)
        regular = [
            _next_working_day(dt.date(year, 1, 1)),
            easter - dt.timedelta(days=2),
            easter + dt.timedelta(days=1),
            monday(dt.date(year, 5, 7)),
            monday(dt.date(year, 5, 31)),
            monday(dt.date(year, 8, 31)),
        ]
        christmas = _next_working_day(dt.date(year, 12, 25))
        boxing = _next_working_day(dt.date(year, 12, 26))
        if dt.date(year, 12, 25).weekday() >= 5:
            christmas, boxing = dt.date(year, 12, 27), _boxing_substitute(year)
        regular += [christmas, boxing]
        days += [MOVED_HOLIDAYS.get(d, d) for d in regular] + EXTRA_HOLIDAYS.get(year, [])
    return sorted(days)


def _next_working_day(day: dt.date) -> dt.date:
    return day + dt.timedelta(days=max(0, 7 - day.weekday()) if day.weekday() >= 5 else 0)


def _boxing_substitute(year: int) -> dt.date:
    """26 December itself when it is a Monday, otherwise the 28th."""
    boxing = dt.date(year, 12, 26)
    return boxing if boxing.weekday() == 0 else dt.date(year, 12, 28)


def easter_sunday(year: int) -> dt.date:
    """Gregorian Easter: the Sunday after the ecclesiastical full moon."""
    century = year // 100
    golden = year % 19
    leap_skips = century - century // 4
    moon_shift = (century - (century - 17) // 25) // 3
    epact = (19 * golden + leap_skips - moon_shift + 15) % 30
    epact -= (epact > 28) or (epact == 28 and golden > 10)
    full_moon = dt.date(year, 3, 21) + dt.timedelta(days=int(epact))
    return full_moon + dt.timedelta(days=(6 - full_moon.weekday()) % 7 or 7)
