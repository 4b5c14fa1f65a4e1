"""Recodes that need counts of the categories themselves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekband.functions.recode import RARE_LABEL, TYPE_GROUPS, merge_categories
from weekband.operators.common import by, join_on_keys
from weekband.session import materialize


def rare_categories(df: DataFrame, column: str, threshold: int = 1000) -> DataFrame:
    """Raw categories with fewer than `threshold` rows; NULL is a category."""
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < threshold).select(column)
    )


def recode_types(
    calls: DataFrame,
    column: str = "incident_type",
    out: str = "incident_type_new",
    groups: Mapping[str, Sequence[str]] = TYPE_GROUPS,
    threshold: int = 1000,
    rare_label: str = RARE_LABEL,
) -> DataFrame:
    """Merged type for every call: listed groups first, then categories rare in the raw data.

    The rare categories are counted first; while they are few, no call is shuffled to find them.
    """
    rare = materialize(
        rare_categories(calls, column, threshold).withColumn("_rare", F.lit(True))
    )
    flagged = join_on_keys(calls, rare, [column], "left")
    merged = merge_categories(F.col(column), groups, F.col("_rare").isNotNull(), rare_label)
    return flagged.withColumn(out, merged).drop("_rare")


def recode_counted_types(
    counted: DataFrame,
    column: str = "incident_type",
    out: str = "incident_type_new",
    groups: Mapping[str, Sequence[str]] = TYPE_GROUPS,
    threshold: int = 1000,
    rare_label: str = RARE_LABEL,
    n: str = "n",
) -> DataFrame:
    """The same recode on a table already counted by raw type, so no call is shuffled for it."""
    rare = F.sum(n).over(by([column])) < threshold
    return counted.withColumn("_rare", rare).withColumn(
        out, merge_categories(F.col(column), groups, F.col("_rare"), rare_label)
    ).drop("_rare")
