"""Areas and their attributes: joins, panels, terciles, before/after sums."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.operators.common import join_on_keys
from weekband.operators.quantiles import values_at
from weekband.operators.series import fill_weeks
from weekband.schema import monday


def with_area(calls: DataFrame, areas: DataFrame, area: str = "area_id") -> DataFrame:
    """Calls with the attributes of their area; unmatched calls keep NULL attributes."""
    return calls.join(areas, area, "left")


def in_known_areas(calls: DataFrame, areas: DataFrame, area: str = "area_id") -> DataFrame:
    return calls.join(areas.select(area), area, "left_semi")


def without_rank(areas: DataFrame, ranked: DataFrame, area: str = "area_id") -> DataFrame:
    """Areas that have no row in the ranked table."""
    return areas.join(ranked.select(area), area, "left_anti")


def areas_per_level(areas: DataFrame, level: str = "imd_decile", area: str = "area_id") -> DataFrame:
    return areas.groupBy(level).agg(F.count_distinct(area).alias("areas"))


def with_group_size(areas: DataFrame, level: str = "imd_decile", area: str = "area_id") -> DataFrame:
    """Areas with the number of areas that share their level."""
    return join_on_keys(areas, areas_per_level(areas, level, area), [level], "inner")


def area_week_panel(
    counts: DataFrame, areas: DataFrame, span: tuple[Column, Column], area: str = "area_id"
) -> DataFrame:
    """Every area and week of the span with its count, zeros included.

    `counts` is (area, week, n). Areas drive: counts elsewhere vanish. The zeros are made after the
    join, so only real counts and areas are shuffled.
    """
    attributes = [c for c in areas.columns if c != area]
    joined = areas.join(counts, area, "left")
    return fill_weeks(joined, [area], {"n": 0}, carry=attributes, span=span)


def calls_by_area(calls: DataFrame, area: str = "area_id", extra: Sequence[str] = ()) -> DataFrame:
    return calls.groupBy(area, *extra).agg(F.count(F.lit(1)).alias("n"))


def all_areas_counted(areas: DataFrame, counts: DataFrame, area: str = "area_id") -> DataFrame:
    """Areas with their count, 0 where there is none."""
    return areas.join(counts, area, "left").fillna(0, ["n"])


def before_after(
    counts: DataFrame, areas: DataFrame, cutoff: dt.date, area: str = "area_id"
) -> DataFrame:
    """Areas with their calls before and from the week of the cutoff.

    Every area of a panel has weeks on both sides, so an area without calls has 0.
    """
    edge = F.lit(monday(cutoff))
    sums = counts.groupBy(area).agg(
        F.sum(F.when(F.col("week") < edge, F.col("n"))).alias("pre"),
        F.sum(F.when(F.col("week") >= edge, F.col("n"))).alias("post"),
    )
    return areas.join(sums, area, "left").fillna(0, ["pre", "post"])


def deprivation_terciles(
    areas: DataFrame, rank: str = "imd_rank", out: str = "dep_level", width: float = 64.0
) -> DataFrame:
    """Level by rank: high, medium, low.

    The group sizes are the numbers of ranks with remainder 0, 1 and 2 modulo 3; the lowest
    ranks are the most deprived. Only the two cut ranks are looked up; no global sort is done.
    """
    ranks = areas.where(F.col(rank).isNotNull())
    sizes = ranks.agg(
        F.count_if(F.col(rank) % 3 == 0).alias("high"),
        F.count_if(F.col(rank) % 3 <= 1).alias("medium"),
    )
    high, medium = sizes.select("high").scalar(), sizes.select("medium").scalar()
    cuts = values_at(ranks, [], rank, {"_high": high - 1, "_medium": medium - 1}, width)
    level = (
        F.when(F.col(rank).isNull(), F.lit(None))
        .when(F.col(rank) <= cuts.select("_high").scalar(), "high")
        .when(F.col(rank) <= cuts.select("_medium").scalar(), "medium")
        .otherwise("low")
    )
    return areas.withColumn(out, level)
