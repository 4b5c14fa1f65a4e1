"""Concentration of calls over areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekband.operators.common import by


def ties(counts: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """(keys, x, m): how many areas have the count `x`; areas without calls are not listed."""
    return (
        counts.where(F.col(value) > 0)
        .groupBy(*keys, F.col(value).alias("x"))
        .agg(F.count(F.lit(1)).alias("m"))
    )


def gini(tied: DataFrame, keys: Sequence[str], areas_total: Column) -> DataFrame:
    """(keys, gini) over `areas_total` areas, of which those not in `tied` have zero calls.

    What is ordered per group is its distinct counts, however many areas there are.
    """
    x, m = F.col("x").cast("double"), F.col("m").cast("double")
    upto = F.sum(m).over(by(keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = tied.withColumn("_last", upto)
    # Sum of rank * value over a tie is value * multiplicity * mean rank; zeros come first.
    rank_sum = F.sum(x * m * (F.col("_last") - (m - 1) / 2))
    size = areas_total.cast("double")
    zeros = size - F.sum(m)
    total = F.sum(x * m)
    return ranked.groupBy(*keys).agg(
        (2 * (rank_sum + zeros * total) / (size * total) - (size + 1) / size).alias("gini")
    )
