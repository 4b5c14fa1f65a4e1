import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekband.operators import series
from weekband.schema import Study

D = dt.date


def w(i):
    return D(2020, 1, 6) + dt.timedelta(weeks=i - 1)


def table(spark, data):
    return spark.createDataFrame([(k, w(i), n) for k, i, n in data], "k string, week date, n long")


def test_weekly_count_keeps_null_key(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 6), None), (dt.datetime(2020, 1, 12, 23), None), (dt.datetime(2020, 1, 13), "x")],
        "incident_date_time timestamp_ntz, k string",
    )
    got = rows(series.weekly_counts(df, ["k"]))
    assert got == [(None, w(1), 2), ("x", w(2), 1)]
    total = series.weekly_counts(df)
    assert total.agg(F.sum("n")).first()[0] == 3


def test_attendance_counts_missing_flags(spark):
    stamp = dt.datetime(2020, 1, 7)
    df = spark.createDataFrame(
        [(stamp, 1), (stamp, 0), (stamp, None), (stamp, 1)], "incident_date_time timestamp_ntz, attended_flag int"
    )
    assert rows(series.weekly_attendance(df), "n", "attended", "percent_attended") == [(4, 2, 50.0)]


def test_attendance_of_missing_flags_only(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 7), None)], "incident_date_time timestamp_ntz, attended_flag int"
    )
    assert rows(series.weekly_attendance(df), "n", "attended", "percent_attended") == [(1, 0, 0.0)]


def test_fill_stays_inside_each_key(spark):
    df = table(spark, [("a", 1, 5), ("a", 3, 6), ("b", 2, 7), ("b", 5, 8), (None, 1, 1), (None, 3, 1)])
    got = rows(series.fill_weeks(df, ["k"], {"n": 0}))
    assert got == [
        (None, w(1), 1), (None, w(2), 0), (None, w(3), 1),
        ("a", w(1), 5), ("a", w(2), 0), ("a", w(3), 6),
        ("b", w(2), 7), ("b", w(3), 0), ("b", w(4), 0), ("b", w(5), 8),
    ]


def test_fill_other_measures_with_null_and_keep_totals(spark):
    df = table(spark, [("a", 1, 5), ("a", 4, 6)]).withColumn("m", F.lit(2.0))
    filled = series.fill_weeks(df, ["k"], {"n": 0})
    assert rows(filled, "week", "n", "m") == [(w(1), 5, 2.0), (w(2), 0, None), (w(3), 0, None), (w(4), 6, 2.0)]


def test_fill_over_a_span(spark):
    df = spark.createDataFrame([("a", w(2), 5), ("b", None, None)], "k string, week date, n long")
    got = rows(series.fill_weeks(df, ["k"], {"n": 0}, span=(F.lit(w(1)), F.lit(w(3)))))
    assert got == [
        ("a", w(1), 0), ("a", w(2), 5), ("a", w(3), 0), ("b", w(1), 0), ("b", w(2), 0), ("b", w(3), 0),
    ]


def grid(spark):
    return table(spark, [(k, i, 1) for k in ("a", "b", "c") for i in range(1, 5)])


def test_trim_edge_weeks(spark):
    got = rows(series.trim_edges(grid(spark), ["k"]), "k", "week")
    assert got == [(k, w(i)) for k in ("a", "b", "c") for i in (2, 3)]


def test_trim_table_rows(spark):
    got = rows(series.trim_edges(grid(spark), ["k"], "table_rows"), "k", "week")
    every = [(k, w(i)) for k in ("a", "b", "c") for i in range(1, 5)]
    assert got == [r for r in every if r not in {("a", w(1)), ("c", w(4))}]


def test_trim_table_rows_puts_null_keys_last(spark):
    df = table(spark, [(None, 1, 1), (None, 2, 1), ("a", 1, 1), ("a", 2, 1)])
    assert rows(series.trim_edges(df, ["k"], "table_rows"), "k", "week") == [(None, w(1)), ("a", w(2))]


def test_trim_group_rows(spark):
    got = rows(series.trim_edges(grid(spark), ["k"], "group_rows"), "k", "week")
    assert got == [("b", w(i)) for i in range(1, 5)]


def test_trim_modes_agree_without_key(spark):
    df = table(spark, [(None, i, i) for i in range(1, 6)]).drop("k")
    assert rows(series.trim_edges(df)) == rows(series.trim_edges(df, [], "table_rows"))
    with pytest.raises(ValueError):
        series.trim_edges(df, [], "other")


def test_future_frame(spark):
    frame = series.future_frame(table(spark, [("a", 1, 1), ("a", 2, 1), (None, 1, 1)]), ["k"], Study())
    assert frame.count() == 96
    assert frame.where("new_system AND hmic_changes").count() == 96
    flagged = [r[0] for r in frame.where("bank_holiday AND k = 'a'").select("week").orderBy("week").collect()]
    assert flagged == [
        D(2020, 4, 6), D(2020, 4, 13), D(2020, 5, 4), D(2020, 5, 25), D(2020, 8, 31), D(2020, 12, 21),
    ]
    assert series.future_frame(grid(spark), [], Study()).count() == 48


def test_key_dates(spark):
    got = rows(series.key_date_table(grid(spark), Study()), "row", "week", "label")
    assert got[0] == (1, D(2020, 1, 27), "1. first UK COVID case")
    assert [r[1] for r in got] == [D(2020, 1, 27), D(2020, 3, 23), D(2020, 6, 15), D(2020, 11, 2), D(2020, 11, 30)]
    labelled = series.with_key_dates(spark.createDataFrame([(D(2020, 3, 23),), (D(2020, 3, 30),)], "week date"), Study())
    assert rows(labelled) == [(D(2020, 3, 23), "2. first lockdown begins"), (D(2020, 3, 30), None)]
