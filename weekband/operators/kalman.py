"""Straight line with first-order errors where weeks may be missing: a Kalman filter as a fold over the weeks.

The error of a week is `phi` times that of the week before plus a shock. Going through the weeks of a series, the filter carries the
expected error and its variance; an observed week corrects both, a missing one is predicted and not corrected, so what is
known fades and the variance grows. The likelihood of the observed weeks chooses `phi` from a grid. A series is one array of its weeks, so
a fold is bounded by them; series and values of `phi` are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.operators.common import join_on_keys
from weekband.schema import Study

#: Values of `phi` that are tried, in hundredths.
GRID = range(-98, 99, 2)


def filtered(errors: Column, phi: Column) -> Column:
    """State after the last week: `mean`, `var` of its error, and over the observed weeks `n`, `squares`, `logs`.

    `errors` has one entry per week, NULL where it is missing. Variances are in units of the shock's.
    """
    start = F.struct(
        F.lit(0.0).alias("mean"), (1 / (1 - phi * phi)).alias("var"), F.lit(0).cast("long").alias("n"),
        F.lit(0.0).alias("squares"), F.lit(0.0).alias("logs"),
    )

    def step(s: Column, e: Column) -> Column:
        mean, var = phi * s["mean"], phi * phi * s["var"] + 1
        miss = e.isNull()
        return F.struct(
            F.when(miss, mean).otherwise(e).alias("mean"),
            F.when(miss, var).otherwise(F.lit(0.0)).alias("var"),
            F.when(miss, s["n"]).otherwise(s["n"] + 1).alias("n"),
            F.when(miss, s["squares"]).otherwise(s["squares"] + (e - mean) * (e - mean) / var).alias("squares"),
            F.when(miss, s["logs"]).otherwise(s["logs"] + F.log(var)).alias("logs"),
        )

    return F.aggregate(errors, start, step)


def fitted_states(train: DataFrame, line: DataFrame, keys: Sequence[str], value: str, fitted: Column) -> DataFrame:
    """(keys, phi, mean, var, sigma2, last_week, n) of the likeliest `phi` of each series; ties go to the smallest.

    `train` has a row for every week of a series, NULL in `value` for a missing one; `line` has the coefficients in `fitted`.
    """
    own = join_on_keys(train.select(*keys, "week", value), line, keys, "inner").withColumn("_e", F.col(value) - fitted)
    weeks = own.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("week", "_e"))), lambda s: s["_e"]).alias("_errors"),
        F.max("week").alias("last_week"),
    )
    tried = weeks.select(*keys, "_errors", "last_week", F.explode(F.array(*[F.lit(p / 100) for p in GRID])).alias("phi"))
    spread = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = tried.repartition(spread, *keys, "phi").withColumn("_s", filtered(F.col("_errors"), F.col("phi")))
    scale = F.greatest(F.col("_s.squares"), F.lit(1e-300)) / F.col("_s.n")
    likelihood = -(F.col("_s.n") * F.log(scale) + F.col("_s.logs")) / 2
    best = run.where("_s.n > 3").select(
        *keys,
        F.struct(F.round(likelihood, 9).alias("likelihood"), (-F.col("phi")).alias("less"), "_s", "last_week").alias("_best"),
    )
    best = best.groupBy(*keys).agg(F.max("_best").alias("_best"))
    s = F.col("_best._s")
    return best.select(
        *keys, (-F.col("_best.less")).alias("phi"), s["mean"].alias("mean"), s["var"].alias("var"),
        (s["squares"] / (s["n"] - 3)).alias("sigma2"), F.col("_best.last_week").alias("last_week"), s["n"].alias("n"),
    )


def kalman_forecast(
    train: DataFrame, line: DataFrame, keys: Sequence[str], value: str, fitted: Column, study: Study, half: float
) -> DataFrame:
    """(keys, week, mean, lower, upper): the line and what is left of the last error; no band below four observed weeks."""
    states = fitted_states(train, line, keys, value, fitted).withColumnsRenamed({"mean": "_mean", "var": "_var"})
    weeks = F.explode(F.array(*(F.lit(w) for w in study.horizon_weeks())))
    h = F.date_diff("week", "last_week") / F.lit(7)
    phi = F.col("phi")
    kept = F.pow(phi * phi, h)
    var = F.col("sigma2") * (kept * F.col("_var") + (1 - kept) / (1 - phi * phi))
    reach = F.lit(half) * F.sqrt(var)
    ahead = join_on_keys(line.select(*keys, "intercept", "slope").withColumn("week", weeks), states, keys, "left")
    banded = ahead.withColumn("mean", F.when(phi.isNotNull(), fitted + F.pow(phi, h) * F.col("_mean")))
    return banded.select(*keys, "week", "mean", (F.col("mean") - reach).alias("lower"), (F.col("mean") + reach).alias("upper"))
