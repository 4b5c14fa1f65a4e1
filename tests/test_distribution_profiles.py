import datetime as dt

import numpy as np
import pytest
from conftest import rows

from weekband.operators import distribution, profiles, shares


def test_boxplot_matches_numpy(spark):
    rng = np.random.default_rng(4)
    data = [("a", float(v)) for v in rng.lognormal(size=301)] + [("b", 5.0)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r["k"]: r for r in distribution.boxplot(df, ["k"], "x", 0.1).collect()}
    x = np.array([v for k, v in data if k == "a"])
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    row = got["a"]
    assert [row[c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high")] == pytest.approx(
        [q1, q2, q3, inside.min(), inside.max()]
    )
    assert row["outliers"] == len(x) - len(inside) and row["n"] == len(x)
    assert distribution.boxplot_outliers(df, ["k"], "x", 0.1).count() == row["outliers"]
    assert got["b"]["whisker_low"] == 5.0 and got["b"]["outliers"] == 0


def test_log_scale_leaves_out_zero(spark):
    df = spark.createDataFrame([(0,), (10,), (None,), (1000,)], "n long")
    assert [r["y"] for r in distribution.log10_positive(df, "n", "y").collect()] == [1.0, 3.0]


def test_density_is_close_to_the_direct_kernel_sum(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(loc=3, size=500)
    df = spark.createDataFrame([("a", float(v), 1) for v in x], "k string, y double, m int")
    got = sorted(distribution.density(df, ["k"], "y").collect(), key=lambda r: r["point"])
    assert len(got) == 512 and got[0]["x"] == pytest.approx(x.min()) and got[-1]["x"] == pytest.approx(x.max())
    iqr = np.subtract(*np.quantile(x, [0.75, 0.25]))
    h = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    at = np.array([r["x"] for r in got])
    direct = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.abs(np.array([r["density"] for r in got]) - direct).max() < 1e-3


def test_density_of_one_value(spark):
    df = spark.createDataFrame([("a", 2.0, 5)], "k string, y double, m int")
    got = distribution.density(df, ["k"], "y").collect()
    assert len(got) == 512 and all(r["x"] == 2.0 for r in got)


def test_summary_without_key(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (6.0,)], "x double")
    assert rows(distribution.summary(df, [], "x")) == [(3, 3.0, 1.0, 6.0, 2.0)]


def weeks(*ns):
    return [dt.date(2020, 1, 6) + dt.timedelta(weeks=n) for n in ns]


def test_profile_averages_active_weeks_only(spark):
    w = weeks(0, 1, 2)
    data = [("pre", "Mon", w[0])] * 3 + [("pre", "Mon", w[2])] * 4 + [("post", "Mon", w[1])]
    df = spark.createDataFrame(data, "period string, dow string, week date")
    # 3.5 rounds to the even neighbour.
    assert rows(profiles.profile(df, "dow")) == [("post", "Mon", 1.0), ("pre", "Mon", 4.0)]


def test_counts_and_calls_give_the_same_average(spark):
    w = weeks(0, 1)
    calls = spark.createDataFrame([("a", w[0])] * 3 + [("a", w[1])], "k string, week date")
    counted = calls.groupBy("k", "week").count().withColumnRenamed("count", "n")
    assert rows(profiles.average_active_week(calls, ["k"])) == rows(profiles.average_active_week(counted, ["k"]))


def test_absent_area_has_zero(spark):
    rows_ = spark.createDataFrame([(1, "pre", weeks(0)[0])], "area_id long, period string, week date")
    areas = spark.createDataFrame([(1,), (2,)], "area_id long")
    got = rows(profiles.average_by_area_period(rows_, areas, ["pre", "post"]), "area_id", "period", "avg_active_week")
    assert got == [(1, "post", 0.0), (1, "pre", 1.0), (2, "post", 0.0), (2, "pre", 0.0)]


def test_wide_profile_with_bounds(spark):
    df = spark.createDataFrame(
        [("pre", "Sun", 50.0), ("pre", "Mon", 60.0), ("post", "Sun", 40.0), ("post", "Mon", 45.0)],
        "period string, dow string, avg_calls double",
    )
    got = {r["period"]: (r["Sun"], r["Mon"]) for r in profiles.wide_with_bounds(df, "dow", ["Sun", "Mon"], "pre", "post").collect()}
    assert got == {"upper limit": (70.0, 70.0), "lower limit": (30.0, 30.0), "pre": (50.0, 60.0), "post": (40.0, 45.0)}


def test_weekly_shares_sum_to_one(spark):
    data = [(dt.datetime(2020, 1, 6), k) for k in ("a", "a", "b", None)]
    df = spark.createDataFrame(data, "incident_date_time timestamp_ntz, k string")
    assert rows(shares.weekly_share(df, "k"), "k", "share") == [(None, 0.25), ("a", 0.5), ("b", 0.25)]
    kept = shares.weekly_share(df, "k", keep_null=False)
    assert rows(kept, "k", "share") == [("a", pytest.approx(2 / 3)), ("b", pytest.approx(1 / 3))]


def test_yearly_change_is_null_first(spark):
    data = [(dt.datetime(1999, 5, 1), 60), (dt.datetime(1999, 6, 1), 40), (dt.datetime(2000, 1, 1), 80), (dt.datetime(1998, 1, 1), 7)]
    df = spark.createDataFrame(data, "incident_date_time timestamp_ntz, n long")
    from pyspark.sql import functions as F

    got = rows(shares.yearly_change(df, [1999, 2000], weight=F.col("n")))
    assert got == [(1999, 100, None), (2000, 80, pytest.approx(-0.2))]


def test_order_by_median(spark):
    df = spark.createDataFrame([("a", 9), ("a", 1), ("b", 2), ("c", 5)], "k string, n long")
    assert rows(shares.order_by_median(df, "k"), "k", "position") == [("a", 2), ("b", 1), ("c", 3)]
