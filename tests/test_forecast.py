import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekband.operators import arima, forecast as fc, smoothing
from weekband.operators.series import fill_weeks
from weekband.schema import Study, monday

STUDY = Study()
FIRST = dt.date(2015, 1, 5)
CUT = monday(STUDY.cutoff)


def weeks_until(last):
    return [FIRST + dt.timedelta(weeks=i) for i in range((last - FIRST).days // 7 + 1)]


def series_of(spark, values):
    return spark.createDataFrame(
        [(k, w, float(v) if v is not None else None) for k, w, v in values], "k string, week date, y double"
    )


def line_rows(key, slope, intercept, until=dt.date(2020, 12, 21)):
    return [(key, w, intercept + slope * i) for i, w in enumerate(weeks_until(until))]


def test_trend_recovers_a_line_exactly(spark):
    series = series_of(spark, line_rows("a", 0.5, 10) + line_rows(None, -0.25, 200))
    band = fc.forecast_band(series, ["k"], "y", STUDY, "trend_ols").cache()
    ahead = band.where("mean IS NOT NULL")
    assert ahead.count() == 96
    assert ahead.where("abs(mean - actual) > 1e-6").count() == 0
    # Report weeks before the horizon have an actual value but no band.
    assert rows(band.where("k = 'a' AND mean IS NULL"), "week") == [
        (d,) for d in (dt.date(2020, 1, 6), dt.date(2020, 1, 13), dt.date(2020, 1, 20))
    ]


def test_level_widens_the_band(spark):
    rng = np.random.default_rng(0)
    series = series_of(spark, [("a", w, 100 + rng.normal()) for w in weeks_until(CUT)])
    width = {}
    for level in (95.0, 99.0):
        row = fc.forecast(series, ["k"], "y", STUDY, "trend_ols", level).first()
        width[level] = row["upper"] - row["lower"]
    assert width[99.0] / width[95.0] == pytest.approx(2.5758293 / 1.9599640, rel=1e-6)


def test_deviation_flag_is_false_for_unknowns(spark):
    week = dt.date(2020, 2, 3)
    days = [week + dt.timedelta(weeks=i) for i in range(5)]
    actual = series_of(spark, [("a", d, v) for d, v in zip(days, (1.0, 2.5, 4.0, None, 4.0))])
    band = spark.createDataFrame(
        [("a", d, 2.5, 2.0, 3.0) for d in days[:4]], "k string, week date, mean double, lower double, upper double"
    )
    got = rows(fc.compare(actual, band, ["k"], "y", STUDY), "week", "sig")
    assert [s for _, s in got] == [True, False, True, False, False]


@pytest.mark.parametrize("method", ["harmonic_ols", "arima"])
def test_models_recover_trend_season_and_steps(spark, method):
    def value(i, w):
        season = 8 * np.sin(2 * np.pi * i / arima.WEEKS_PER_YEAR) + 3 * np.cos(4 * np.pi * i / arima.WEEKS_PER_YEAR)
        return 50 + 0.1 * i + season + (12 if w > monday(STUDY.new_system) else 0)

    series = series_of(spark, [("a", w, value(i, w)) for i, w in enumerate(weeks_until(dt.date(2020, 12, 21)))])
    band = fc.forecast_band(series, ["k"], "y", STUDY, method).where("mean IS NOT NULL").cache()
    assert band.count() == 48
    assert band.where("abs(mean - actual) > 0.05").count() == 0
    assert band.where("NOT (lower <= mean AND mean <= upper)").count() == 0


def test_arima_shape_gaps_and_short_keys(spark):
    rng = np.random.default_rng(5)
    long = [("a", w, v) for w, v in zip(weeks_until(CUT), 100 + np.cumsum(rng.normal(size=400)))]
    gappy = [(None, w, 5 + rng.normal()) for i, w in enumerate(weeks_until(CUT)) if i % 7]
    short = [("s", w, 1.0) for w in weeks_until(FIRST + dt.timedelta(weeks=6))]
    series = fill_weeks(series_of(spark, long + gappy + short), ["k"], {"y": None})
    band = fc.forecast(series, ["k"], "y", STUDY, "arima").cache()
    assert sorted(r["count"] for r in band.groupBy("k").count().collect()) == [48, 48, 48]
    assert band.where("k = 's' AND (lower IS NOT NULL OR mean IS NOT NULL)").count() == 0
    for key in ("k = 'a'", "k IS NULL"):
        got = [r["upper"] - r["lower"] for r in band.where(key).orderBy("week").collect()]
        assert all(b >= a - 1e-9 for a, b in zip(got, got[1:]))
    flagged = fc.compare(series, band, ["k"], "y", STUDY)
    assert flagged.where("k = 's' AND sig").count() == 0


def test_fitted_values_stay_close(spark):
    series = series_of(spark, line_rows("a", 0.5, 10, CUT))
    for fitted in (
        fc.fitted_values(series, ["k"], "y", STUDY),
        fc.trend_fitted(series, ["k"], "y", STUDY).drop("y"),
    ):
        joined = fitted.join(series, ["k", "week"])
        assert joined.count() == len(weeks_until(CUT)) - 1
        assert joined.where("abs(fitted - y) > 1e-6").count() == 0


def test_ar1_interval_covers_about_95_percent():
    rng = np.random.default_rng(11)
    t = np.arange(312.0)
    none = np.zeros((312, 0))
    inside = total = 0
    for _ in range(30):
        e, x = rng.normal(size=312), np.zeros(312)
        for i in range(1, 312):
            x[i] = 0.6 * x[i - 1] + e[i]
        y = 20 + x
        out = arima.regression_forecast(t[:264], y[:264], none[:264], t[264:], none[264:], True)
        inside += int(np.sum(np.abs(y[264:] - out.mean) <= 1.96 * out.sd))
        total += 48
    assert 0.85 <= inside / total <= 0.99


def test_psi_and_pi_weights_are_inverse():
    ar, ma = np.array([0.5, -0.3]), np.array([0.4])
    pi, psi = arima.pi_weights(ar, ma, 60), arima.psi_weights(ar, ma, 60)
    product = np.convolve(pi, psi)[:60]
    assert product == pytest.approx(np.eye(1, 60)[0], abs=1e-9)


def test_dependent_columns_are_dropped():
    x = np.column_stack([np.ones(9), np.arange(9.0), np.arange(9.0) * 2 + 1, np.zeros(9), np.arange(9.0) ** 2])
    assert arima.independent_columns(x) == [0, 1, 4]


def test_report_slice_clamps_and_labels(spark):
    band = spark.createDataFrame(
        [("a", dt.date(2020, 1, 27), 1.0, 2.0, -3.0, 5.0, False), ("a", dt.date(2020, 2, 3), 1.0, 2.0, None, None, False),
         ("b", dt.date(2020, 1, 27), 1.0, 2.0, 1.0, 5.0, False), ("a", dt.date(2021, 1, 4), 1.0, 2.0, 1.0, 5.0, False)],
        "k string, week date, actual double, mean double, lower double, upper double, sig boolean",
    )
    got = rows(fc.report_slice(band, "k", ["a"], STUDY), "week", "lower", "events")
    assert got == [(dt.date(2020, 1, 27), 0.0, "1. first UK COVID case"), (dt.date(2020, 2, 3), None, None)]
    assert rows(fc.significant_weeks(band.withColumn("sig", F.col("k") == "a"), ["k"])) == [("a", 3), ("b", 0)]


def test_bad_arguments(spark):
    series = series_of(spark, line_rows("a", 1, 1, CUT))
    with pytest.raises(ValueError):
        fc.forecast(series, ["k"], "y", STUDY, "prophecy")
    with pytest.raises(ValueError):
        fc.forecast(series.drop("k"), [], "y", STUDY, "arima")


def test_smoother_reproduces_a_quadratic(spark):
    data = [("a", w, 3 + 0.2 * i + 0.01 * i * i) for i, w in enumerate(weeks_until(dt.date(2016, 12, 26)))]
    out = smoothing.smooth(series_of(spark, data), ["k"], "y", 0.3)
    assert out.where("abs(smoothed - y) > 1e-6 OR smoothed IS NULL").count() == 0
    few = smoothing.smooth(series_of(spark, data[:5]), ["k"], "y", 0.2)
    assert few.where("smoothed IS NOT NULL").count() == 0


def test_band_widens_when_a_key_ends_early():
    """A random walk that ended 20 weeks before the horizon is as uncertain there as 20 weeks ahead."""
    from weekband.operators.arima import regression_forecast

    draw = np.random.default_rng(4)
    t = np.arange(200.0)
    y, none = np.cumsum(draw.normal(0, 2, 200)), np.zeros((200, 2))
    now = regression_forecast(t, y, none, np.arange(200.0, 230.0), np.zeros((30, 2)), True)
    late = regression_forecast(t, y, none, np.arange(220.0, 230.0), np.zeros((10, 2)), True)
    assert late.sd[0] == pytest.approx(now.sd[20]) and late.sd[0] > 2 * now.sd[0]
    assert len(late.mean) == 10
