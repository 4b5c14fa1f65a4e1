"""Area by week panels, one table with the type as a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.operators.series import fill_weeks, with_week

ALL_TYPES = "all"


def panel_counts(calls: DataFrame, types: Mapping[str, Sequence[str] | None], type_col: str) -> DataFrame:
    """(panel, area_id, week, n): a panel counts its types, or every call if it lists none."""
    counted = (
        with_week(calls).groupBy("area_id", "week", type_col).agg(F.count(F.lit(1)).alias("n"))
    )
    hits = F.array(
        *(
            F.lit(name) if members is None else F.when(F.col(type_col).isin(list(members)), name)
            for name, members in types.items()
        )
    )
    return (
        counted.withColumn("panel", F.explode(F.array_compact(hits)))
        .groupBy("panel", "area_id", "week")
        .agg(F.sum("n").alias("n"))
    )


def area_week_panels(
    calls: DataFrame,
    areas: DataFrame,
    span: tuple[Column, Column],
    types: Mapping[str, Sequence[str] | None],
    type_col: str = "incident_type_new",
) -> DataFrame:
    """Every panel, area and week of the span with its count, zeros included.

    Calls are counted in one pass for all panels. Zero rows are made after the join, in place.
    """
    attributes = [c for c in areas.columns if c != "area_id"]
    frame = areas.withColumn("panel", F.explode(F.array(*(F.lit(p) for p in types))))
    joined = frame.join(panel_counts(calls, types, type_col), ["area_id", "panel"], "left")
    return fill_weeks(joined, ["area_id", "panel"], {"n": 0}, carry=attributes, span=span)
