"""Shares of a total: within weeks, within keys, per area."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekband.functions.calendar import year_of
from weekband.operators.common import by, join_on_keys
from weekband.operators.quantiles import median
from weekband.operators.series import EVENT_TIME, fill_weeks, weekly_counts


def share_of_total(df: DataFrame, value: str, within: Sequence[str], out: str, scale: float = 1.0) -> DataFrame:
    """value / sum(value) over `within`, times `scale`; NULL where the total is zero."""
    total = F.nullif(F.sum(value).over(by(within)).cast("double"), F.lit(0.0))
    return df.withColumn(out, F.col(value).cast("double") / total * F.lit(scale))


def weekly_share(
    calls: DataFrame, key: str, keep_null: bool = True, extra: Sequence[str] = (), scale: float = 1.0
) -> DataFrame:
    """(extra, key, week, n, share) with shares that sum to `scale` in each week."""
    rows = calls if keep_null else calls.where(F.col(key).isNotNull())
    return share_of_total(weekly_counts(rows, [*extra, key]), "n", [*extra, "week"], "share", scale)


def yearly_share(calls: DataFrame, key: str) -> DataFrame:
    """(key, year, n, share) where a key's shares sum to 1 over the years."""
    counts = calls.groupBy(key, year_of(F.col(EVENT_TIME)).alias("year")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return share_of_total(counts, "n", [key], "share")


def yearly_change(
    calls: DataFrame, years: Sequence[int], ts: str = EVENT_TIME, weight: Column | None = None
) -> DataFrame:
    """(year, n, change): weighted total and its relative change from the previous kept year."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # A range of dates reaches the scan; the years themselves do not.
    first, last = dt.date(min(years), 1, 1), dt.date(max(years) + 1, 1, 1)
    inside = (F.col(ts) >= F.lit(first)) & (F.col(ts) < F.lit(last))
    yearly = (
        calls.where(inside).groupBy(year_of(F.col(ts)).alias("year"))
        .agg(total.alias("n"))
        .where(F.col("year").isin(list(years)))
    )
    previous = F.lag("n").over(by([]).orderBy("year")).cast("double")
    change = (F.col("n") - previous) / F.nullif(previous, F.lit(0.0))
    return yearly.withColumn("change", change)


def order_by_median(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """(key, median, position): categories in ascending order of their median value."""
    medians = median(counts, [key], value, 16.0).drop("n")
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("median", key))
    return medians.withColumn("position", position)


def area_adjusted_share(
    counts: DataFrame,
    areas: DataFrame,
    level: str = "imd_decile",
    area: str = "area_id",
    extra: Sequence[str] = (),
    span: tuple[Column, Column] | None = None,
    keep_null: bool = True,
) -> DataFrame:
    """Each level's weekly calls per area, and its share of the week.

    `counts` is (extra, area, week, n) without zeros; a level with no calls in a week gets 0. `span`
    is the range of weeks before its first and last week are dropped. Counts of areas outside
    `areas` are left out.
    """
    if not keep_null:
        areas = areas.where(F.col(level).isNotNull())
    located = join_on_keys(counts, areas.select(area, level), [area], "inner")
    sums = located.groupBy(*extra, level, "week").agg(F.sum("n").alias("n"))
    if span is None:
        ends = sums.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
        span = (ends.select("lo").scalar(), ends.select("hi").scalar())
    inside = sums.where((F.col("week") > span[0]) & (F.col("week") < span[1]))
    # Levels are few: a week travels as one row with a list of them.
    weekly = inside.groupBy(*extra, "week").agg(
        F.collect_list(F.struct(F.col(level).alias("level"), "n")).alias("_seen")
    )
    full = fill_weeks(weekly, extra, {}, span=(F.date_add(span[0], 7), F.date_sub(span[1], 7)))
    sizes = areas.groupBy(level).agg(F.count_distinct(area).alias("areas"))
    levels = sizes.agg(F.collect_list(F.struct(F.col(level).alias("level"), "areas")).alias("v")).scalar()
    rows = full.withColumn("_of", F.explode(levels)).withColumn(
        "n",
        F.aggregate(
            F.coalesce(F.filter("_seen", lambda s: s.level.eqNullSafe(F.col("_of.level"))), F.array()),
            F.lit(0).cast("bigint"),
            lambda total, s: total + s.n,
        ),
    )
    per_area = rows.select(
        *extra,
        F.col("_of.level").alias(level),
        "week",
        "n",
        F.col("_of.areas").alias("areas"),
        (F.col("n").cast("double") / F.col("_of.areas")).alias("calls_per_area"),
    )
    return share_of_total(per_area, "calls_per_area", [*extra, "week"], "share")
