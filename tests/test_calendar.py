import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekband.functions import calendar as cal
from weekband.schema import Study, monday

D = dt.date


@pytest.mark.parametrize(
    ("day", "week"),
    [
        (D(2017, 6, 3), D(2017, 5, 29)),
        (D(2017, 5, 15), D(2017, 5, 15)),
        (D(2020, 1, 31), D(2020, 1, 27)),
        (D(2019, 12, 31), D(2019, 12, 30)),
        (D(2020, 1, 23), D(2020, 1, 20)),
        (D(2020, 11, 5), D(2020, 11, 2)),
        (D(2020, 12, 2), D(2020, 11, 30)),
    ],
)
def test_week_anchor(spark, day, week):
    assert monday(day) == week
    assert spark.range(1).select(cal.week_of(F.lit(day))).first()[0] == week


def test_horizon_has_48_weeks():
    weeks = Study().horizon_weeks()
    assert (len(weeks), weeks[0], weeks[-1]) == (48, D(2020, 1, 27), D(2020, 12, 21))


def test_shifted_study_moves_every_date():
    moved = Study().shifted(-20)
    assert moved.cutoff == D(2000, 1, 31)
    assert moved.holiday_years == (1995, 1996, 1997, 1998, 1999, 2000)
    assert len(moved.horizon_weeks()) == 48


def test_shift_edges(spark):
    stamps = [(h, dt.datetime(2020, 5, 1, h)) for h in (4, 5, 10, 11, 16, 17, 22, 23)]
    df = spark.createDataFrame([*stamps, (99, None)], "h int, ts timestamp_ntz")
    got = dict(rows(df.select("h", cal.shift_band(F.col("ts")))))
    assert got == {
        4: "Late", 5: "Early", 10: "Early", 11: "Daytime", 16: "Daytime",
        17: "Evening", 22: "Evening", 23: "Late", 99: None,
    }


def test_weekday_label_and_day_dummy(spark):
    df = spark.createDataFrame([(D(2020, 3, 1),), (D(2020, 3, 2),), (None,)], "d date")
    got = rows(df.select("d", cal.weekday_label(F.col("d")), cal.since_day(F.col("d"), D(2020, 3, 2))))
    assert got == [(None, None, None), (D(2020, 3, 1), "Sun", 0), (D(2020, 3, 2), "Mon", 1)]


def test_intervention_starts_the_week_after(spark):
    df = spark.createDataFrame([(D(2017, 5, 29),), (D(2017, 6, 5),)], "week date")
    got = rows(df.select("week", cal.after_week_of(F.col("week"), D(2017, 6, 3))))
    assert got == [(D(2017, 5, 29), False), (D(2017, 6, 5), True)]


def test_period_edge(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 30, 23, 59)), (2, dt.datetime(2020, 1, 31)), (3, None)],
        "i int, ts timestamp_ntz",
    )
    cut = D(2020, 1, 31)
    got = rows(df.select("i", cal.period(F.col("ts"), cut), cal.period(F.col("ts"), cut, include_cutoff=True)))
    assert got == [(1, "Pre-COVID", "Pre-COVID"), (2, "2020", "Pre-COVID"), (3, None, None)]


@pytest.mark.parametrize(
    ("year", "easter"),
    [(1981, D(1981, 4, 19)), (1995, D(1995, 4, 16)), (2000, D(2000, 4, 23)), (2015, D(2015, 4, 5)),
     (2018, D(2018, 4, 1)), (2020, D(2020, 4, 12)), (2049, D(2049, 4, 18)), (2076, D(2076, 4, 19))],
)
def test_easter(year, easter):
    assert cal.easter_sunday(year) == easter


def test_bank_holidays_with_substitutes():
    assert cal.london_holidays([2020]) == [
        D(2020, 1, 1), D(2020, 4, 10), D(2020, 4, 13), D(2020, 5, 8), D(2020, 5, 25),
        D(2020, 8, 31), D(2020, 12, 25), D(2020, 12, 28),
    ]
    assert D(2017, 1, 2) in cal.london_holidays([2017])
    assert cal.london_holidays([2016])[-2:] == [D(2016, 12, 26), D(2016, 12, 27)]
    assert cal.london_holidays([2021])[-2:] == [D(2021, 12, 27), D(2021, 12, 28)]


def test_holiday_week_flag(spark):
    df = spark.createDataFrame([(D(2020, 4, 6),), (D(2020, 4, 20),)], "week date")
    got = rows(df.select("week", cal.is_holiday_week(F.col("week"), [2020])))
    assert got == [(D(2020, 4, 6), True), (D(2020, 4, 20), False)]
