"""Average calls per active week by weekday, shift, hour or area, before and after a cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.functions.durations import round_half_even
from weekband.operators.common import join_on_keys


def average_active_week(
    rows: DataFrame, keys: Sequence[str], out: str = "avg_active_week", rounded: bool = False
) -> DataFrame:
    """Calls per key divided by the weeks in which the key has any.

    `rows` holds `week` and either one row per call or a count `n` per (keys, week, ...).
    """
    counted = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    weekly = rows.groupBy(*keys, "week").agg(counted.alias("_n"))
    mean = F.avg("_n")
    return weekly.groupBy(*keys).agg((round_half_even(mean, 0) if rounded else mean).alias(out))


def profile(rows: DataFrame, slot: str, period: str = "period") -> DataFrame:
    """(period, slot, avg_calls) rounded to whole calls."""
    return average_active_week(rows, [period, slot], "avg_calls", rounded=True)


def widen(profile_rows: DataFrame, slot: str, slots: Sequence, period: str = "period") -> DataFrame:
    """One row per period and one column per slot."""
    return profile_rows.groupBy(period).pivot(slot, list(slots)).agg(F.first("avg_calls"))


def chart_bounds(
    profile_rows: DataFrame, before: str, after: str, margin: float = 10.0, period: str = "period"
) -> DataFrame:
    """Upper limit over the earlier period and lower limit over the later one."""
    value = F.col("avg_calls")
    return profile_rows.agg(
        (F.max(F.when(F.col(period) == before, value)) + margin).alias("upper_limit"),
        (F.min(F.when(F.col(period) == after, value)) - margin).alias("lower_limit"),
    )


def wide_with_bounds(
    profile_rows: DataFrame,
    slot: str,
    slots: Sequence,
    before: str,
    after: str,
    margin: float = 10.0,
    period: str = "period",
) -> DataFrame:
    """The radar table: an upper row, a lower row, then one row per period."""
    bounds = chart_bounds(profile_rows, before, after, margin, period)

    def limit_row(label: str, column: str) -> DataFrame:
        return bounds.select(F.lit(label).alias(period), *(F.col(column).alias(str(s)) for s in slots))

    return (
        limit_row("upper limit", "upper_limit")
        .unionByName(limit_row("lower limit", "lower_limit"))
        .unionByName(widen(profile_rows, slot, slots, period))
    )


def average_by_area_period(
    rows: DataFrame,
    areas: DataFrame,
    periods: Sequence[str],
    area: str = "area_id",
    period: str = "period",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Every area and period with its average active week, 0 where it has no calls.

    With `extra` (such as the type of call) there is one row for each of its values that the calls have.
    """
    averages = average_active_week(rows, [area, period, *extra])
    labels: Column = F.array(*(F.lit(p) for p in periods))
    frame = areas.withColumn(period, F.explode(labels))
    if extra:
        # The values are categories; their list is a scalar next to every area.
        values = averages.agg(F.collect_set(F.struct(*extra)).alias("v")).scalar()
        frame = frame.withColumn("_v", F.explode(values)).select(*frame.columns, "_v.*")
    return join_on_keys(frame, averages, [area, period, *extra], "left").fillna(0.0, ["avg_active_week"])
