"""The three analyses end to end: area layer, panels and forecasts to store, deprivation report.

    spark-submit --py-files weekband.zip weekband/plans/pipeline.py \
        --calls calls/ --areas layer.parquet --out results/ --method arima
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.functions.calendar import period, week_of
from weekband.operators import areas as area_ops
from weekband.operators import distribution, geometry, profiles, series, shares
from weekband.operators.recode import recode_types
from weekband.plans.panels import area_week_panels
from weekband.plans.products import Names, Recode, all_products, forecast_products
from weekband.schema import Study
from weekband.session import build_session, materialize
from weekband.sources.files import read_calls, write_results

BEFORE, AFTER = "Pre-COVID", "2020"


def canonical(calls: DataFrame) -> DataFrame:
    """Calls with the area name under the name the operators use."""
    return calls.withColumnRenamed("lsoa", "area_id")


def build_layer(
    boundary: DataFrame,
    layer: DataFrame,
    deprivation: DataFrame,
    cell: float,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Areas that meet the boundary, only the listed ones if a list is given, with deprivation.

    `boundary` has `boundary_id` and `rings`, the other tables `area_id`. Areas that the
    deprivation table lacks keep NULL attributes.
    """
    met = geometry.areas_meeting(layer, boundary, "area_id", "boundary_id", cell)
    if listed is not None:
        met = area_ops.in_known_areas(met, listed)
    return area_ops.with_area(met, deprivation)


def week_range(calls: DataFrame) -> DataFrame:
    """(lo, hi): first and last week of the calls."""
    week = week_of(F.col("incident_date_time"))
    return materialize(calls.agg(F.min(week).alias("lo"), F.max(week).alias("hi")))


def _ends(span: DataFrame) -> tuple[Column, Column]:
    return span.select("lo").scalar(), span.select("hi").scalar()


def store_panels(
    calls: DataFrame, areas: DataFrame, path: str, names: Names = Names(), recode: Recode = Recode()
) -> None:
    """The area by week panels of all calls and of six types, one partition each."""
    members = {
        "all": None,
        "asb": (names.asb,),
        "drugs": (names.drugs,),
        "missing person": (names.missing,),
        "domestic": (names.domestic,),
        "violence": (names.violence,),
        "admin": (names.admin,),
    }
    merged = recode_types(calls, groups=recode.types, threshold=recode.rare_below)
    panel = area_week_panels(merged, areas.drop("rings"), _ends(week_range(calls)), members)
    write_results(panel, path, ("panel",))


def store_forecasts(
    calls: DataFrame,
    areas: DataFrame,
    study: Study,
    path: str,
    method: str = "arima",
    names: Names = Names(),
    recode: Recode = Recode(),
    negative_scene: bool = False,
) -> None:
    """All forecast products in one table, a partition per metric."""
    ranked = materialize(areas.select("area_id", "imd_rank"))
    levels = materialize(area_ops.deprivation_terciles(ranked))
    band = forecast_products(
        calls, levels, week_range(calls), study, all_products(names), recode, method, negative_scene=negative_scene
    )
    # One file per metric instead of one per task and metric.
    write_results(band.repartition("metric"), path)


def deprivation_report(
    calls: DataFrame,
    areas: DataFrame,
    study: Study,
    types: Mapping[str, Sequence[str]] | None = None,
    type_col: str = "incident_type_new",
) -> dict[str, DataFrame]:
    """Tables of the deprivation report, over the calls of known areas.

    `totals` are box statistics of log10 calls per decile, `before_after` those of average
    active weeks per decile and period, `weekly_share` the share of each decile per area and week.
    With `types`, `weekly_share` is split by their labels, and `totals_by_type` and `before_after_by_type` are there as well.
    """
    attributes = materialize(areas.select("area_id", "imd_decile"))
    known = area_ops.in_known_areas(series.with_week(calls), attributes)
    ranked = attributes.where(F.col("imd_decile").isNotNull())
    period_label = period(F.col("incident_date_time"), study.cutoff, BEFORE, AFTER)
    if types:
        label = F.coalesce(*(F.when(F.col(type_col).isin(list(m)), n) for n, m in types.items()))
        extra = ["type"]
        known = known.withColumn("type", label)
    else:
        extra = []
    counted = materialize(
        known.withColumn("period", period_label)
        .groupBy("area_id", *extra, "period", "week")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counted.groupBy("area_id").agg(F.sum("n").alias("n")).join(ranked, "area_id")
    logged = materialize(distribution.log10_positive(totals, "n", "log_n"))
    averages = materialize(profiles.average_by_area_period(counted, ranked, [BEFORE, AFTER]))
    weekly = counted.groupBy("area_id", *extra, "week").agg(F.sum("n").alias("n"))
    if extra:
        weekly = weekly.where(F.col("type").isNotNull())
    report = {
        "totals": distribution.boxplot(logged, ["imd_decile"], "log_n", 0.01),
        "before_after": distribution.boxplot(averages, ["imd_decile", "period"], "avg_active_week", 0.25),
        "weekly_share": shares.area_adjusted_share(
            weekly, attributes, extra=extra, span=_ends(week_range(calls))
        ),
    }
    if extra:
        typed = counted.where(F.col("type").isNotNull())
        sums = typed.groupBy("area_id", "type").agg(F.sum("n").alias("n")).join(ranked, "area_id")
        logged = materialize(distribution.log10_positive(sums, "n", "log_n"))
        averages = materialize(profiles.average_by_area_period(typed, ranked, [BEFORE, AFTER], extra=extra))
        report["totals_by_type"] = distribution.boxplot(logged, ["type", "imd_decile"], "log_n", 0.01)
        report["before_after_by_type"] = distribution.boxplot(
            averages, ["type", "imd_decile", "period"], "avg_active_week", 0.25
        )
    return report


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--calls", required=True, help="CSV folder of calls")
    parser.add_argument("--areas", required=True, help="Parquet layer with area_id, imd_rank, imd_decile")
    parser.add_argument("--out", required=True)
    parser.add_argument("--method", default="arima")
    parser.add_argument("--negative-scene", action="store_true", help="keep negative times on scene")
    args = parser.parse_args()
    spark = build_session("weekband")
    # The CSV is read once; everything below reads columns of the copy.
    calls = materialize(canonical(read_calls(spark, args.calls)))
    areas = spark.read.parquet(args.areas)
    store_panels(calls, areas, f"{args.out}/panels")
    store_forecasts(calls, areas, Study(), f"{args.out}/forecasts", args.method, negative_scene=args.negative_scene)
    merged = recode_types(calls)
    for name, table in deprivation_report(merged, areas, Study()).items():
        table.write.mode("overwrite").parquet(f"{args.out}/deprivation/{name}")


if __name__ == "__main__":
    main()
