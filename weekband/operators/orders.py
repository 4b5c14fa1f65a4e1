"""How a series is differenced and how many weeks its errors reach back, as statistics of the series.

Level stationarity (KPSS) comes from running sums and autocovariances, the order from autocovariances alone by Levinson's recursion, which
gives the error of every order up to the last from that of the one before. All of it is folds over one array per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value of the statistic beyond which a series is not level at 5 %.
KPSS_LIMIT = 0.463


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _centred(values: Column) -> Column:
    mean = _total(values) / F.size(values)
    return F.transform(values, lambda v: v - mean)


def autocovariance(centred: Column, lag: Column) -> Column:
    """Mean product of values `lag` apart, over all values."""
    n = F.size(centred)
    ahead = F.slice(centred, lag + 1, F.greatest(n - lag, F.lit(0)))
    behind = F.slice(centred, F.lit(1), F.greatest(n - lag, F.lit(0)))
    return _total(F.zip_with(ahead, behind, lambda a, b: a * b)) / n


def kpss(centred: Column) -> Column:
    """The statistic with Bartlett weights up to 3 sqrt(n) / 13 lags; NULL if the long-run variance is not positive."""
    n = F.size(centred)
    lags = F.floor(3 * F.sqrt(n.cast("double")) / 13).cast("int")
    weighted = F.transform(
        F.when(lags > 0, F.sequence(F.lit(1), lags)).otherwise(F.array().cast("array<int>")),
        lambda k: 2 * (1 - k / (lags + 1)) * autocovariance(centred, k),
    )
    variance = autocovariance(centred, F.lit(0)) + _total(weighted)
    run = F.aggregate(
        centred,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("squares")),
        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["squares"] + (a["s"] + v) * (a["s"] + v)).alias("squares")),
    )
    return F.when(variance > 0, run["squares"] / (n * n * variance))


def levinson(gamma: Column, last: int) -> Column:
    """Array of (p, error) for orders 0 to `last`, from autocovariances at lags 0 to `last`."""
    start = F.struct(
        F.array().cast("array<double>").alias("phi"),
        F.element_at(gamma, 1).alias("error"),
        F.array(F.struct(F.lit(0).alias("p"), F.element_at(gamma, 1).alias("error"))).alias("orders"),
    )

    def step(s: Column, p: Column) -> Column:
        past = F.slice(F.reverse(F.slice(gamma, 2, p - 1)), F.lit(1), p - 1)  # lags p - 1 to 1
        explained = _total(F.zip_with(s["phi"], past, lambda a, g: a * g))
        part = F.when(s["error"] > 0, (F.element_at(gamma, p + 1) - explained) / s["error"]).otherwise(F.lit(0.0))
        kept = F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - part * b)
        error = s["error"] * (1 - part * part)
        return F.struct(
            F.concat(kept, F.array(part)).alias("phi"),
            error.alias("error"),
            F.concat(s["orders"], F.array(F.struct(p.alias("p"), error.alias("error")))).alias("orders"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(last)), start, step)["orders"]


def order_choice(series: DataFrame, keys: Sequence[str], value: str, last: int = 4) -> DataFrame:
    """(keys, n, kpss, d, p, criterion): differences and autoregressive order of every series with more than `last` + 3 weeks.

    `series` has all weeks; a NULL value is left out. `d` is 1 where the level is not stationary. `p` has the smallest corrected Akaike
    criterion of the (differenced) series, the smaller order on a tie (after rounding to nine digits).
    """
    held = F.array_sort(F.collect_list(F.struct("week", F.col(value).cast("double").alias("v"))))
    known = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.transform(held, lambda s: s["v"]).alias("_x"))
    spread = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.where(F.size("_x") > last + 3).repartition(spread, *keys)
    tested = known.withColumn("_c", _centred(F.col("_x"))).withColumn("kpss", kpss(F.col("_c")))
    d = F.when(F.col("kpss") > KPSS_LIMIT, 1).otherwise(0)
    steps = F.zip_with(F.slice("_x", F.lit(2), F.size("_x") - 1), F.slice("_x", F.lit(1), F.size("_x") - 1), lambda b, a: b - a)
    used = tested.withColumn("d", d).withColumn("_y", F.when(F.col("d") == 1, _centred(steps)).otherwise(F.col("_c")))
    lags = F.array(*[F.lit(k) for k in range(last + 1)])
    gamma = used.withColumn("_g", F.transform(lags, lambda k: autocovariance(F.col("_y"), k)))
    m = F.size("_y").cast("double")
    scored = gamma.withColumn("_o", levinson(F.col("_g"), last)).withColumn(
        "_best",
        F.array_min(
            F.transform(
                "_o",
                lambda o: F.struct(
                    F.round(
                        m * F.log(F.greatest(o["error"], F.lit(1e-300)))
                        + 2 * (o["p"] + 1) + 2 * (o["p"] + 1) * (o["p"] + 2) / (m - o["p"] - 2),
                        9,
                    ).alias("criterion"),
                    o["p"].alias("p"),
                ),
            )
        ),
    )
    return scored.select(*keys, F.size("_x").cast("long").alias("n"), "kpss", "d", F.col("_best.p").alias("p"), F.col("_best.criterion").alias("criterion"))
