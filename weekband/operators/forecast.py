"""Forecast band per series and the flag for weeks outside it."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekband.functions.durations import clamp_at_zero
from weekband.operators.arima import regression_forecast
from weekband.operators.common import join_on_keys
from weekband.operators.harmonic import harmonic_fitted, harmonic_forecast
from weekband.operators.kalman import kalman_forecast
from weekband.operators.series import add_regressors, future_frame, with_key_dates
from weekband.schema import Study, monday

cloudpickle.register_pickle_by_value(sys.modules[__name__])

METHODS = ("trend_ols", "trend_ar1", "trend_kalman", "harmonic_ols", "arima")
DUMMIES = ("new_system", "hmic_changes", "bank_holiday")


def normal_quantile(level: float) -> float:
    """Half-width of a central interval of `level` percent, in standard deviations."""
    return NormalDist().inv_cdf(0.5 + level / 200.0)


def training(series: DataFrame, study: Study) -> DataFrame:
    """Weeks before the week of the cutoff."""
    return series.where(F.col("week") < F.lit(monday(study.cutoff)))


def _weeks_from_cutoff(week: Column, study: Study) -> Column:
    return (F.date_diff(week, F.lit(monday(study.cutoff))) / F.lit(7)).cast("double")


def trend_coefficients(series: DataFrame, keys: Sequence[str], value: str, study: Study) -> DataFrame:
    """(keys, n, intercept, slope, sigma) of a straight line over the training weeks."""
    t = _weeks_from_cutoff(F.col("week"), study)
    y = F.col(value).cast("double")
    sums = training(series, study).groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.regr_intercept(y, t).alias("intercept"),
        F.regr_slope(y, t).alias("slope"),
        F.regr_syy(y, t).alias("_syy"),
        F.regr_sxy(y, t).alias("_sxy"),
    )
    error = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    sigma = F.when(F.col("n") > 2, F.sqrt(error / (F.col("n") - 2)))
    return sums.select(*keys, "n", "intercept", "slope", sigma.alias("sigma"))


def _line(study: Study) -> Column:
    return F.col("intercept") + F.col("slope") * _weeks_from_cutoff(F.col("week"), study)


def trend_fitted(series: DataFrame, keys: Sequence[str], value: str, study: Study) -> DataFrame:
    """Training weeks with the fitted value of the straight line."""
    line = trend_coefficients(series, keys, value, study)
    train = training(series, study).select(*keys, "week", value)
    return join_on_keys(train, line.drop("n"), keys, "inner").select(
        *keys, "week", value, _line(study).alias("fitted")
    )


def trend_ar1(series: DataFrame, keys: Sequence[str], value: str, study: Study, level: float) -> DataFrame:
    """(keys, week, mean, lower, upper): straight line with errors that follow the one of the week before.

    The share that carries over is the slope of each error on the last; the band widens with the distance from the
    last training week in closed form. One window per series, which is bounded by its weeks.
    """
    fitted = trend_fitted(series, keys, value, study).withColumn("_e", F.col(value) - F.col("fitted"))
    before = F.lag("_e").over(Window.partitionBy(*keys).orderBy("week"))
    sums = fitted.withColumn("_p", before).groupBy(*keys).agg(
        F.regr_slope("_e", "_p").alias("phi"),
        F.regr_syy("_e", "_p").alias("_syy"),
        F.regr_sxy("_e", "_p").alias("_sxy"),
        F.regr_count("_e", "_p").alias("_n"),
        F.max_by("_e", "week").alias("_last"),
        F.max("week").alias("_end"),
    )
    phi, square = F.col("phi"), F.col("phi") * F.col("phi")
    sigma2 = F.greatest(F.col("_syy") - phi * F.col("_sxy"), F.lit(0.0)) / F.nullif(F.col("_n") - 2, F.lit(0))
    h = F.date_diff("week", "_end") / F.lit(7)
    grown = F.when(F.abs(1 - square) < 1e-9, h).otherwise((1 - F.pow(square, h)) / (1 - square))
    half = F.lit(normal_quantile(level)) * F.sqrt(sigma2 * grown)
    weeks = F.array(*(F.lit(w) for w in study.horizon_weeks()))
    line = trend_coefficients(series, keys, value, study).select(*keys, "intercept", "slope")
    return (
        join_on_keys(sums, line, keys, "inner")
        .withColumn("week", F.explode(weeks))
        .withColumn("mean", _line(study) + F.pow(phi, h) * F.col("_last"))
        .select(*keys, "week", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))
    )


def forecast(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    study: Study,
    method: str = "arima",
    level: float = 95.0,
) -> DataFrame:
    """(keys, week, mean, lower, upper) for every horizon week of every key with training weeks.

    `trend_ols` and `harmonic_ols` are one aggregate, `trend_ar1` adds a window, and `trend_kalman`, for series with missing
    weeks, a fold over the weeks. `arima` fits each series in a grouped function: its group is one series, so it is bounded by
    the number of weeks, and series are spread over tasks by key.
    """
    if method == "trend_ols":
        line = trend_coefficients(series, keys, value, study)
        weeks = F.array(*(F.lit(w) for w in study.horizon_weeks()))
        half = F.lit(normal_quantile(level)) * F.col("sigma")
        return (
            line.withColumn("week", F.explode(weeks))
            .withColumn("mean", _line(study))
            .select(
                *keys,
                "week",
                "mean",
                (F.col("mean") - half).alias("lower"),
                (F.col("mean") + half).alias("upper"),
            )
        )
    if method == "trend_ar1":
        return trend_ar1(series, keys, value, study, level)
    if method == "trend_kalman":
        line = trend_coefficients(series, keys, value, study)
        return kalman_forecast(training(series, study), line, keys, value, _line(study), study, normal_quantile(level))
    if method == "harmonic_ols":
        return harmonic_forecast(training(series, study), keys, value, study, normal_quantile(level))
    fitted = _fit_groups(series, keys, value, study, method, level)
    return fitted.where("is_future").drop("is_future")


def fitted_values(
    series: DataFrame, keys: Sequence[str], value: str, study: Study, method: str = "arima"
) -> DataFrame:
    """(keys, week, fitted) over the training weeks, one step ahead for `arima`."""
    if method == "harmonic_ols":
        return harmonic_fitted(training(series, study), keys, value, study)
    fitted = _fit_groups(series, keys, value, study, method, 95.0)
    return fitted.where("NOT is_future").select(*keys, "week", F.col("mean").alias("fitted"))


def _fit_groups(
    series: DataFrame, keys: Sequence[str], value: str, study: Study, method: str, level: float
) -> DataFrame:
    if method != "arima":
        raise ValueError(f"method must be one of {METHODS}")
    if not keys:
        raise ValueError("give a key column, a constant one for a single series")
    known = add_regressors(
        training(series, study).select(*keys, "week", F.col(value).cast("double").alias("_y")), study
    )
    ahead = future_frame(known, keys, study)
    rows = known.withColumn("is_future", F.lit(False)).unionByName(
        ahead.withColumn("is_future", F.lit(True)), allowMissingColumns=True
    )
    outputs = [
        T.StructField("week", T.DateType()),
        T.StructField("is_future", T.BooleanType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
    ]
    schema = T.StructType([*(series.schema[k] for k in keys), *outputs])
    half, names = normal_quantile(level), list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_series(pdf, names, half, True)

    # An explicit number of partitions keeps adaptive execution from packing all series into one.
    spread = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, *keys).groupBy(*keys).applyInPandas(fit, schema)


def fit_series(pdf: pd.DataFrame, keys: list[str], half: float, arma: bool) -> pd.DataFrame:
    """Fit the training rows of one series and fill in mean and bounds for all its rows."""
    pdf = pdf.sort_values("week")
    future = pdf["is_future"].to_numpy(dtype=bool)
    weeks = pd.to_datetime(pdf["week"]).to_numpy().astype("datetime64[D]").astype(float) / 7.0
    t = weeks - weeks[~future].min()
    dummies = pdf[list(DUMMIES)].to_numpy(dtype=float)
    y = pdf["_y"].to_numpy(dtype=float)
    result = regression_forecast(
        t[~future], y[~future], dummies[~future], t[future], dummies[future], arma
    )
    mean, reach = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
    if result is not None:
        mean[~future], mean[future] = result.fitted, result.mean
        reach[future] = half * result.sd
    out = pdf[[*keys, "week", "is_future"]]
    return out.assign(mean=mean, lower=mean - reach, upper=mean + reach)


def compare(
    series: DataFrame, band: DataFrame, keys: Sequence[str], value: str, study: Study
) -> DataFrame:
    """Actual against band: (keys, week, actual, mean, lower, upper, sig).

    A full outer join: report weeks before the horizon have no band, horizon weeks without data have no
    actual, and neither is significant.
    """
    actual = series.where(F.col("week") > F.lit(monday(study.report_after))).select(
        *keys, "week", F.col(value).cast("double").alias("actual")
    )
    joined = join_on_keys(actual, band, [*keys, "week"], "full")
    outside = (F.col("actual") < F.col("lower")) | (F.col("actual") > F.col("upper"))
    return joined.select(
        *keys, "week", "actual", "mean", "lower", "upper", F.coalesce(outside, F.lit(False)).alias("sig")
    )


def forecast_band(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    study: Study,
    method: str = "arima",
    level: float = 95.0,
) -> DataFrame:
    """Fit, forecast and compare. The series is read twice: pass a materialised one."""
    band = forecast(series, keys, value, study, method, level)
    return compare(series, band, keys, value, study)


def report_slice(
    band: DataFrame, key: str, values: Sequence[str], study: Study
) -> DataFrame:
    """Chosen keys of a band for a report: lower bound clamped at zero, key dates attached."""
    first = F.lit(monday(study.report_after)) + F.expr("interval 7 days")
    last = F.lit(study.horizon_weeks()[-1])
    chosen = band.where(F.col(key).isin(list(values)) & F.col("week").between(first.cast("date"), last))
    return with_key_dates(chosen.withColumn("lower", clamp_at_zero(F.col("lower"))), study)


def significant_weeks(band: DataFrame, keys: Sequence[str]) -> DataFrame:
    return band.groupBy(*keys).agg(F.count_if("sig").alias("sig_weeks"))
