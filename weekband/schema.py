"""Fixed schemas and the dates of a study."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import types as T

CALLS = T.StructType(
    [
        T.StructField("incident_date_time", T.TimestampNTZType()),
        T.StructField("incident_type", T.StringType()),
        T.StructField("call_origin", T.StringType()),
        T.StructField("initial_grade_of_response", T.StringType()),
        T.StructField("attended_flag", T.IntegerType()),
        T.StructField("earliest_deployed_date_time", T.TimestampNTZType()),
        T.StructField("earliest_arrived_date_time", T.TimestampNTZType()),
        T.StructField("released_date_time", T.TimestampNTZType()),
        T.StructField("lsoa", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Study:
    """Dates that steer training, the forecast horizon and the intervention dummies."""

    cutoff: dt.date = dt.date(2020, 1, 31)
    horizon_from: dt.date = dt.date(2020, 1, 31)
    horizon_to: dt.date = dt.date(2020, 12, 31)
    report_after: dt.date = dt.date(2019, 12, 31)
    new_system: dt.date = dt.date(2017, 6, 3)
    hmic_changes: dt.date = dt.date(2017, 5, 15)
    holiday_years: tuple[int, ...] = (2015, 2016, 2017, 2018, 2019, 2020)
    key_dates: tuple[tuple[dt.date, str], ...] = (
        (dt.date(2020, 1, 31), "first UK COVID case"),
        (dt.date(2020, 3, 23), "first lockdown begins"),
        (dt.date(2020, 6, 15), "first lockdown ends"),
        (dt.date(2020, 11, 5), "second lockdown begins"),
        (dt.date(2020, 12, 2), "second lockdown ends"),
    )

    def horizon_weeks(self) -> list[dt.date]:
        """Mondays of every seventh day from the start to the end of the horizon."""
        days = (self.horizon_to - self.horizon_from).days
        return [monday(self.horizon_from + dt.timedelta(days=d)) for d in range(0, days + 1, 7)]

    def shifted(self, years: int) -> Study:
        """The same study moved by whole years."""

        def move(day: dt.date) -> dt.date:
            return day.replace(year=day.year + years)

        return Study(
            cutoff=move(self.cutoff),
            horizon_from=move(self.horizon_from),
            horizon_to=move(self.horizon_to),
            report_after=move(self.report_after),
            new_system=move(self.new_system),
            hmic_changes=move(self.hmic_changes),
            holiday_years=tuple(y + years for y in self.holiday_years),
            key_dates=tuple((move(d), event) for d, event in self.key_dates),
        )


def monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())
