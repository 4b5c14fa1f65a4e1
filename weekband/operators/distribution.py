"""Summaries of a distribution: range and averages, box statistics, density estimate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekband.operators.common import join_on_keys
from weekband.operators.quantiles import quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def summary(df: DataFrame, keys: Sequence[str], value: str, width: float = 60.0) -> DataFrame:
    """n, mean, min, max and exact median of the non-null values, in one pass."""
    marks = quantiles(df, keys, value, {"min": 0.0, "median": 0.5, "max": 1.0}, width)
    mean = F.col("total") / F.nullif(F.col("n"), F.lit(0))
    return marks.select(*keys, "n", mean.alias("mean"), "min", "max", "median")


def log10_positive(df: DataFrame, value: str, out: str) -> DataFrame:
    """Logarithm of the positive values; the rest has no place on a log scale and is left out."""
    return df.where(F.col(value) > 0).withColumn(out, F.log10(F.col(value).cast("double")))


def boxplot(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and how many values lie outside.

    `df` is read twice: pass a materialised table.
    """
    box = quantiles(df, keys, value, QUARTILES, width).drop("total")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = join_on_keys(df.select(*keys, value), box, keys, "inner")
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return fenced.groupBy(*keys, "n", *QUARTILES).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def boxplot_outliers(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """The rows that lie beyond the whiskers."""
    box = quantiles(df, keys, value, QUARTILES, width).select(*keys, "q1", "q3")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    beyond = ~F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return join_on_keys(df, box, keys, "inner").where(beyond).drop("q1", "q3")


def density(
    counted: DataFrame, keys: Sequence[str], value: str, weight: str = "m", points: int = 512
) -> DataFrame:
    """(keys, point, x, density): Gaussian kernel estimate at equally spaced points.

    `counted` is (keys, value, weight), already transformed to the plotting scale; it is read
    more than once, so pass a materialised table. The bandwidth is the rule of thumb
    0.9 * min(sd, IQR / 1.34) * n^(-1/5). Weights are split between the two nearest of `points`
    bins over the data range, so the kernel runs over bins, never over calls.
    """
    y, m = F.col(value), F.col(weight)
    moments = counted.groupBy(*keys).agg(
        F.sum(m).cast("double").alias("_n"),
        F.sum(m * y).alias("_s1"),
        F.sum(m * y * y).alias("_s2"),
        F.min(y).alias("_lo"),
        F.max(y).alias("_hi"),
    )
    box = quantiles(counted, keys, value, {"_q1": 0.25, "_q3": 0.75}, 0.01, weight).drop("n", "total")
    sd = F.sqrt((F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n")) / (F.col("_n") - 1))
    spread = F.least(sd, (F.col("_q3") - F.col("_q1")) / 1.34)
    spread = F.when(spread > 0, spread).when(sd > 0, sd).otherwise(F.lit(1.0))
    shape = join_on_keys(moments, box, keys, "inner").select(
        *keys,
        "_n",
        "_lo",
        ((F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))).alias("_step"),
        (0.9 * spread * F.pow(F.col("_n"), F.lit(-0.2))).alias("_h"),
    )
    at = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_step"), F.lit(0.0))
    placed = (
        join_on_keys(counted, shape, keys, "inner")
        .withColumn("_at", F.coalesce(at, F.lit(0.0)))
        .withColumn("_left", F.least(F.floor("_at"), F.lit(points - 2)))
        .withColumn("_frac", F.col("_at") - F.col("_left"))
        .withColumn(
            "_part",
            F.explode(
                F.array(
                    F.struct(F.col("_left").alias("bin"), (m * (1 - F.col("_frac"))).alias("w")),
                    F.struct((F.col("_left") + 1).alias("bin"), (m * F.col("_frac")).alias("w")),
                )
            ),
        )
    )
    bins = placed.groupBy(*keys, "_n", "_lo", "_step", "_h", F.col("_part.bin").alias("_bin")).agg(
        F.sum("_part.w").alias("_w")
    )
    spread_out = bins.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    distance = (F.col("point") - F.col("_bin")) * F.col("_step") / F.col("_h")
    kernel = F.exp(-0.5 * distance * distance) / (F.col("_h") * math.sqrt(2 * math.pi))
    return spread_out.groupBy(*keys, "point").agg(
        F.max(F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
        F.sum(F.col("_w") / F.col("_n") * kernel).alias("density"),
    )
