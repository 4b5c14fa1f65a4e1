"""Spatial weights, lag, and Moran's I.

Values and neighbour lists are read several times: pass materialised tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL_Z = 1.959964


def row_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w): each area's weights sum to 1. Areas without neighbours have no row."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_degree"))
    return edges.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("_degree")).alias("w"))


def isolates(areas: DataFrame, edges: DataFrame, area: str = "area_id") -> DataFrame:
    """Areas without neighbours."""
    return areas.join(edges.select(F.col("src").alias(area)), area, "left_anti")


def spatial_lag(values: DataFrame, weights: DataFrame, value: str, area: str = "area_id") -> DataFrame:
    """Areas that have neighbours, with `lag` = sum of weight * value over them."""
    neighbours = values.select(F.col(area).alias("dst"), F.col(value).alias("_x"))
    sums = (
        weights.join(neighbours, "dst")
        .groupBy(F.col("src").alias(area))
        .agg(
            F.sum(F.col("w") * F.col("_x")).alias("lag"),
            F.sum("w").alias("w_sum"),
            F.sum(F.col("w") * F.col("w")).alias("w_square"),
        )
    )
    return values.join(sums, area)


def _moments(lagged: DataFrame, value: str) -> tuple[Column, Column, Column, Column]:
    """n, mean, sum of squares and of fourth powers about the mean, as scalar subqueries."""
    x = F.col(value).cast("double")
    n, mean = (lagged.agg(f).scalar() for f in (F.count(F.lit(1)), F.avg(x)))
    z = x - mean
    squares, fourths = (lagged.agg(F.sum(F.pow(z, F.lit(p)))).scalar() for p in (2, 4))
    return n.cast("double"), mean, squares, fourths


def moran_global(lagged: DataFrame, value: str) -> DataFrame:
    """One row: n, moran_i and sample kurtosis; `lagged` comes from `spatial_lag`."""
    n, mean, squares, fourths = _moments(lagged, value)
    z = F.col(value) - mean
    cross = F.sum(z * (F.col("lag") - F.col("w_sum") * mean))
    return lagged.agg(F.count(F.lit(1)).alias("n"), cross.alias("_cross"), F.sum("w_sum").alias("_s0")).select(
        "n",
        (n / F.col("_s0") * F.col("_cross") / F.nullif(squares, F.lit(0.0))).alias("moran_i"),
        (n * fourths / F.nullif(squares * squares, F.lit(0.0))).alias("kurtosis"),
    )


def moran_local(lagged: DataFrame, value: str, conditional: bool = True) -> DataFrame:
    """Per area: z, lag_z, local_i, its expectation, variance and z_score.

    `conditional` takes the moments given the value at the area itself; otherwise they are taken
    over all permutations.
    """
    n, mean, squares, fourths = _moments(lagged, value)
    m2 = squares / n
    z = F.col("z")
    wi, wi2 = F.col("w_sum"), F.col("w_square")
    base = lagged.withColumn("z", F.col(value) - mean).withColumn(
        "lag_z", F.col("lag") - wi * mean
    )
    if conditional:
        expectation = -(z * z * wi) / ((n - 1) * m2)
        variance = (
            F.pow(z / m2, F.lit(2))
            * (n / (n - 2))
            * (wi2 - wi * wi / (n - 1))
            * (m2 - z * z / (n - 1))
        )
    else:
        b2 = (fourths / n) / (m2 * m2)
        expectation = -wi / (n - 1)
        variance = (
            (n - b2) / (n - 1) * wi2
            + (2 * b2 - n) / ((n - 1) * (n - 2)) * (wi * wi - wi2)
            - expectation * expectation
        )
    return (
        base.withColumn("local_i", z / m2 * F.col("lag_z"))
        .withColumn("expectation", expectation)
        .withColumn("variance", variance)
        .withColumn(
            "z_score",
            F.try_divide(F.col("local_i") - F.col("expectation"), F.sqrt("variance")),
        )
    )


# Coefficients of the rational approximation of the normal tail, highest power first, and its bound.
TAIL_UP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DOWN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_BOUND = 7.07106781186547


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal exceeds z: a ratio of polynomials, beyond the bound a continued fraction."""
    size = F.abs(z)
    up, down = F.lit(0.0), F.lit(0.0)
    for factor in TAIL_UP:
        up = up * size + F.lit(factor)
    for factor in TAIL_DOWN:
        down = down * size + F.lit(factor)
    far = size + 0.65
    for k in (4, 3, 2, 1):
        far = size + F.lit(float(k)) / far
    ratio = F.when(size < TAIL_BOUND, up / down).otherwise(1 / (far * F.lit(math.sqrt(2 * math.pi))))
    beyond = F.exp(-size * size / 2) * ratio
    return F.when(z >= 0, beyond).otherwise(1 - beyond)


def with_p_value(local: DataFrame, alternative: str = "two.sided") -> DataFrame:
    z = F.col("z_score")
    p = {
        "two.sided": lambda: 2.0 * upper_tail(F.abs(z)),
        "greater": lambda: upper_tail(z),
        "less": lambda: upper_tail(-z),
    }[alternative]()
    return local.withColumn("p_value", p)


def quadrants(local: DataFrame, significant: Column | None = None, out: str = "quadrant") -> DataFrame:
    """Class by the signs of value and lag where significant (by default two-sided at 5 %)."""
    if significant is None:
        significant = F.abs("z_score") >= F.lit(CRITICAL_Z)
    own = F.when(F.col("z") > 0, "high").otherwise("low")
    around = F.when(F.col("lag_z") > 0, "high").otherwise("low")
    return local.withColumn(
        out, F.when(significant, F.concat_ws("-", own, around)).otherwise("non-significant")
    )


def standardize(df: DataFrame, value: str, out: str) -> DataFrame:
    """(x - mean) / sd with the n - 1 denominator."""
    mean, sd = (df.agg(f(value)).scalar() for f in (F.avg, F.stddev_samp))
    return df.withColumn(out, (F.col(value) - mean) / F.nullif(sd, F.lit(0.0)))
