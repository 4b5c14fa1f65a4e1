"""Named queries over the star-schema test tables, one per operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekband.functions.calendar import (
    SHIFTS,
    WEEKDAYS,
    day_of,
    period,
    shift_band,
    since_day,
    week_of,
    weekday_label,
)
from weekband.functions.durations import minutes_between, pseudo_log, repair_half_day, sign_class
from weekband.functions.recode import merge_categories, merge_origins, yes_no
from weekband.operators import (
    areas as area_ops,
    distribution,
    forecast as fc,
    geometry,
    moran,
    orders,
    profiles,
    recode,
    series,
    shares,
    smoothing,
)
from weekband.operators.concentration import gini, ties
from weekband.plans import panels, products
from weekband.session import materialize
from weekband.sources import star_tables as star
from weekband.sources.star_tables import STUDY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MERGED = "incident_type_new"
TYPE_GROUPS = {
    "group a": ("Brand#1", "Brand#2"),
    "group b": ("Brand#3", "Brand#4", "Brand#5"),
    "group c": ("Brand#7",),
    "group d": ("Brand#8", "Brand#9"),
    "group e": ("Brand#14", "Brand#15"),
    "group f": ("Brand#16",),
    "group g": ("Brand#17", "Brand#18"),
    "group h": ("Brand#19",),
}
RARE_TYPES_BELOW = 2000
RARE_ORIGINS_BELOW = 12000
ORIGIN_GROUPS = {"public non-emergency": ("AUTOMOBILE", "BUILDING"), "household": ("HOUSEHOLD",)}
UNKNOWN_ORIGINS = ("FURNITURE",)
NAMES = products.Names("Brand#10", "group a", "Brand#11", "group b", "Brand#12", "group c")
GRADE, TYPE, ORIGIN, AREA = (
    "initial_grade_of_response",
    "incident_type",
    "call_origin",
    "area_id",
)
EARLY_CUTOFF = dt.date(2000, 1, 23)
EVENTS_CUTOFF = dt.date(2024, 1, 16)
OUTLIER_DAY = dt.date(2024, 1, 10)
BEFORE, AFTER = "Pre-COVID", "2020"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def origin_new() -> Column:
    return merge_origins(F.col(ORIGIN), ORIGIN_GROUPS, UNKNOWN_ORIGINS)


def with_response(calls: DataFrame) -> DataFrame:
    """Attended calls with raw and repaired response minutes."""
    raw = minutes_between(F.col("earliest_deployed_date_time"), F.col("earliest_arrived_date_time"))
    return (
        calls.where(F.col("attended_flag") == 1)
        .withColumn("raw_minutes", raw)
        .withColumn("minutes", repair_half_day(F.col("raw_minutes")))
    )


def with_scene(calls: DataFrame) -> DataFrame:
    tos = minutes_between(F.col("earliest_arrived_date_time"), F.col("released_date_time"))
    return calls.where(F.col("attended_flag") == 1).withColumn("tos_minutes", tos)


RESPONSE = ("attended_flag", "earliest_deployed_date_time", "earliest_arrived_date_time")
SCENE = ("attended_flag", "earliest_arrived_date_time", "released_date_time")


def weekly_types(spark: SparkSession, d: str) -> DataFrame:
    """Weekly counts by merged type, merged after counting."""
    raw = series.weekly_counts(star.calls(spark, d, [TYPE]), [TYPE])
    merged = recode.recode_counted_types(raw, groups=TYPE_GROUPS, threshold=RARE_TYPES_BELOW)
    return merged.groupBy("incident_type_new", "week").agg(F.sum("n").alias("n"))


def typed(calls: DataFrame) -> DataFrame:
    """Calls with their merged type; types rare among all calls are folded into one."""
    return recode.recode_types(calls, groups=TYPE_GROUPS, threshold=RARE_TYPES_BELOW)


def areas_of(spark: SparkSession, d: str) -> DataFrame:
    """The area table, made durable: it is small next to the calls and read several times."""
    return materialize(star.areas(spark, d))


def call_weeks(weekly: DataFrame) -> DataFrame:
    """One row (lo, hi): first and last week of counted calls."""
    return weekly.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))


def ends(weekly: DataFrame) -> tuple[Column, Column]:
    weeks = call_weeks(weekly)
    return weeks.select("lo").scalar(), weeks.select("hi").scalar()


def in_areas(counts: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Counts of listed areas only."""
    listed = star.table(spark, d, "supplier").select(F.col("s_suppkey").alias(AREA))
    return counts.join(listed, AREA, "left_semi")


# Scans, literal tables, scalar functions


@query
def key_dates(spark: SparkSession, d: str) -> DataFrame:
    weekly = series.weekly_counts(star.calls(spark, d, []))
    return series.key_date_table(weekly, STUDY).join(weekly, "week", "left")


@query
def week_grid(spark: SparkSession, d: str) -> DataFrame:
    weeks = call_weeks(series.weekly_counts(star.calls(spark, d, [])))
    return weeks.select(F.explode(series.week_grid(F.col("lo"), F.col("hi"))).alias("week"))


@query
def recode_types(spark: SparkSession, d: str) -> DataFrame:
    merged = recode.recode_types(
        star.calls(spark, d, [TYPE]), groups=TYPE_GROUPS, threshold=RARE_TYPES_BELOW
    )
    return merged.groupBy(TYPE, "incident_type_new").agg(n_rows())


@query
def rare_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = recode.recode_types(
        star.calls(spark, d, [ORIGIN]), ORIGIN, "origin_folded", {}, RARE_ORIGINS_BELOW
    )
    return folded.groupBy(ORIGIN, "origin_folded").agg(n_rows())


@query
def recode_origin(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, [ORIGIN]).withColumn("origin_new", origin_new())
    return calls.groupBy(ORIGIN, "origin_new").agg(n_rows())


@query
def shift_band_counts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("incident_date_time")
    return (
        star.timed_calls(spark, d).groupBy(shift_band(ts).alias("shift"), F.hour(ts).alias("hour")).agg(n_rows())
    )


@query
def intervention_days(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("incident_date_time")
    return (
        star.calls(spark, d, [])
        .groupBy(
            since_day(ts, STUDY.new_system).alias("system_change"),
            since_day(ts, STUDY.hmic_changes).alias("inspection"),
        )
        .agg(n_rows())
    )


@query
def period_counts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("incident_date_time")
    return (
        star.calls(spark, d, [])
        .groupBy(
            period(ts, STUDY.cutoff).alias("period"),
            period(ts, EARLY_CUTOFF).alias("early_period"),
            period(ts, STUDY.cutoff, include_cutoff=True).alias("closed_period"),
        )
        .agg(n_rows())
    )


@query
def attended_classes(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, ["attended_flag"])
    return calls.groupBy(yes_no(F.col("attended_flag")).alias("attended")).agg(n_rows())


@query
def response_time(spark: SparkSession, d: str) -> DataFrame:
    timed = with_response(star.calls(spark, d, RESPONSE))
    return rounded(timed.groupBy("raw_minutes", "minutes").agg(n_rows()), 4, "raw_minutes", "minutes")


@query
def time_on_scene(spark: SparkSession, d: str) -> DataFrame:
    timed = with_scene(star.calls(spark, d, SCENE))
    return rounded(timed.groupBy("tos_minutes").agg(n_rows()), 4, "tos_minutes")


@query
def negative_duration_split(spark: SparkSession, d: str) -> DataFrame:
    timed = with_scene(star.calls(spark, d, SCENE))
    return timed.groupBy(sign_class(F.col("tos_minutes")).alias("sign")).agg(n_rows())


# Joins


@query
def calls_with_area(spark: SparkSession, d: str) -> DataFrame:
    counts = area_ops.calls_by_area(star.calls(spark, d, [AREA]))
    return area_ops.with_area(counts, star.deprivation_sheet(areas_of(spark, d)))


@query
def calls_in_known_areas(spark: SparkSession, d: str) -> DataFrame:
    sheet = star.deprivation_sheet(areas_of(spark, d))
    known = area_ops.in_known_areas(star.calls(spark, d, [AREA, GRADE]), sheet)
    return known.groupBy(GRADE).agg(n_rows(), F.count_distinct(AREA).alias("areas"))


@query
def areas_without_rank(spark: SparkSession, d: str) -> DataFrame:
    everywhere = areas_of(spark, d)
    return area_ops.without_rank(everywhere, star.deprivation_sheet(everywhere)).select(AREA)


@query
def area_week_panel(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(series.weekly_counts(star.calls(spark, d, [AREA]), [AREA]))
    return area_ops.area_week_panel(counts, areas_of(spark, d), ends(counts))


def type_panels(spark: SparkSession, d: str) -> DataFrame:
    """Every panel, area and week with its calls."""
    by_panel = {
        "all": None,
        "asb": (NAMES.asb,),
        "drugs": (NAMES.drugs,),
        "missing person": (NAMES.missing,),
        "domestic": (NAMES.domestic,),
        "violence": (NAMES.violence,),
        "admin": (NAMES.admin,),
    }
    calls = star.calls(spark, d, [AREA, TYPE]).withColumn(
        "incident_type_new", merge_categories(F.col(TYPE), TYPE_GROUPS)
    )
    weekly = materialize(series.weekly_counts(star.calls(spark, d, [])))
    return panels.area_week_panels(calls, areas_of(spark, d), ends(weekly), by_panel)


@query
def area_week_panels(spark: SparkSession, d: str) -> DataFrame:
    return type_panels(spark, d).groupBy("panel", AREA, "imd_decile").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.sum("n").alias("n"),
        F.count_if(F.col("n") == 0).alias("empty_weeks"),
    )


@query
def area_week_panel_rows(spark: SparkSession, d: str) -> DataFrame:
    return type_panels(spark, d).select("panel", AREA, "imd_decile", "week", "n")


@query
def deprived_areas_alone(spark: SparkSession, d: str) -> DataFrame:
    """Areas of the most deprived tenth that touch no other one of it."""
    deprived = areas_of(spark, d).where(F.col("imd_decile") == 1).select(AREA)
    layer = materialize(star.layer(spark, d).join(deprived, AREA, "left_semi"))
    return moran.isolates(deprived, geometry.queen_neighbours(layer))


@query
def areas_intersecting(spark: SparkSession, d: str) -> DataFrame:
    layer = star.layer(spark, d)
    return geometry.areas_meeting(layer, star.boundary(spark), AREA, "boundary_id", 2.0).select(AREA)


@query
def queen_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return geometry.queen_neighbours(star.layer(spark, d))


# Series


@query
def count_by_origin(spark: SparkSession, d: str) -> DataFrame:
    return star.calls(spark, d, [ORIGIN]).groupBy(ORIGIN).agg(n_rows())


@query
def weekly_total(spark: SparkSession, d: str) -> DataFrame:
    return series.weekly_counts(star.calls(spark, d, []))


@query
def weekly_by_type(spark: SparkSession, d: str) -> DataFrame:
    return weekly_types(spark, d)


@query
def weekly_of_types(spark: SparkSession, d: str) -> DataFrame:
    return series.weekly_series(star.calls(spark, d, [TYPE]), TYPE_GROUPS["group b"])


@query
def weekly_by_origin(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, [ORIGIN]).withColumn("origin_new", origin_new())
    return series.weekly_counts(calls, ["origin_new"])


@query
def weekly_by_grade(spark: SparkSession, d: str) -> DataFrame:
    return series.weekly_counts(star.calls(spark, d, [GRADE]), [GRADE])


@query
def daily_count(spark: SparkSession, d: str) -> DataFrame:
    return series.daily_counts(star.timed_calls(spark, d))


@query
def daily_count_without_outlier(spark: SparkSession, d: str) -> DataFrame:
    return series.daily_counts(star.timed_calls(spark, d)).where(F.col("day") != F.lit(OUTLIER_DAY))


@query
def attendance_weekly(spark: SparkSession, d: str) -> DataFrame:
    return series.weekly_attendance(star.calls(spark, d, ["attended_flag"]))


@query
def attendance_by_type(spark: SparkSession, d: str) -> DataFrame:
    calls = typed(star.calls(spark, d, ["attended_flag", TYPE]))
    return series.weekly_attendance(calls, ["incident_type_new"])


@query
def attendance_by_grade(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, ["attended_flag", GRADE])
    graded = calls.where(F.col(GRADE).isin(list(products.ATTENDED_GRADES)))
    return series.weekly_attendance(graded, [GRADE])


@query
def median_response_weekly(spark: SparkSession, d: str) -> DataFrame:
    timed = with_response(star.calls(spark, d, RESPONSE))
    return rounded(series.weekly_median(timed, "minutes"), 3, "median")


@query
def median_response_by_type(spark: SparkSession, d: str) -> DataFrame:
    timed = with_response(typed(star.calls(spark, d, [*RESPONSE, TYPE])))
    return rounded(series.weekly_median(timed, "minutes", ["incident_type_new"]), 3, "median")


@query
def median_response_by_grade(spark: SparkSession, d: str) -> DataFrame:
    timed = with_response(star.calls(spark, d, [*RESPONSE, GRADE]))
    return rounded(series.weekly_median(timed, "minutes", [GRADE]), 3, "median")


@query
def median_scene_by_grade(spark: SparkSession, d: str) -> DataFrame:
    timed = with_scene(star.calls(spark, d, [*SCENE, GRADE]))
    kept = timed.where((F.col("tos_minutes") >= 0) & F.col(GRADE).isin(list(products.ATTENDED_GRADES)))
    return rounded(series.weekly_median(kept, "tos_minutes", [GRADE]), 3, "median")


@query
def duration_summary(spark: SparkSession, d: str) -> DataFrame:
    timed = with_response(star.calls(spark, d, RESPONSE))
    return rounded(distribution.summary(timed, [], "raw_minutes"), 3, "mean", "min", "max", "median")


@query
def duration_summary_by_grade(spark: SparkSession, d: str) -> DataFrame:
    timed = with_response(star.calls(spark, d, [*RESPONSE, GRADE]))
    return rounded(distribution.summary(timed, [GRADE], "raw_minutes"), 3, "mean", "min", "max", "median")


def weekly_origins(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, [ORIGIN]).withColumn("origin_new", origin_new())
    return materialize(series.weekly_counts(calls, ["origin_new"]))


@query
def trim_edge_weeks(spark: SparkSession, d: str) -> DataFrame:
    return series.trim_edges(weekly_origins(spark, d), ["origin_new"])


@query
def trim_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return series.trim_edges(weekly_origins(spark, d), ["origin_new"], "table_rows")


@query
def trim_group_rows(spark: SparkSession, d: str) -> DataFrame:
    return series.trim_edges(weekly_origins(spark, d), ["origin_new"], "group_rows")


@query
def gap_fill_weekly(spark: SparkSession, d: str) -> DataFrame:
    return series.fill_weeks(series.weekly_counts(star.calls(spark, d, [AREA]), [AREA]), [AREA], {"n": 0})


@query
def series_regressors(spark: SparkSession, d: str) -> DataFrame:
    weekly = series.weekly_counts(star.calls(spark, d, [GRADE]), [GRADE])
    return series.add_regressors(series.fill_weeks(weekly, [GRADE], {"n": 0}), STUDY)


@query
def future_frame(spark: SparkSession, d: str) -> DataFrame:
    return series.future_frame(star.calls(spark, d, [GRADE]), [GRADE], STUDY)


# Shares and profiles


@query
def shift_share_weekly(spark: SparkSession, d: str) -> DataFrame:
    calls = star.timed_calls(spark, d).withColumn("shift", shift_band(F.col("incident_date_time")))
    return rounded(shares.weekly_share(calls, "shift"), 9, "share")


@query
def attended_share_weekly(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, ["attended_flag"]).withColumn("attended", yes_no(F.col("attended_flag")))
    return rounded(shares.weekly_share(calls, "attended"), 9, "share")


@query
def origin_share_weekly(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, [ORIGIN]).withColumn("origin_new", origin_new())
    return rounded(shares.weekly_share(calls, "origin_new", keep_null=False), 9, "share")


@query
def origin_share_weekly_by_type(spark: SparkSession, d: str) -> DataFrame:
    calls = typed(star.calls(spark, d, [ORIGIN, TYPE]))
    share = shares.weekly_share(calls, ORIGIN, keep_null=False, extra=["incident_type_new"])
    return rounded(share, 9, "share")


@query
def origin_year_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.yearly_share(star.calls(spark, d, [ORIGIN]), ORIGIN), 9, "share")


@query
def origin_order(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, [ORIGIN]).where(F.col(ORIGIN).isNotNull())
    return shares.order_by_median(series.weekly_counts(calls, [ORIGIN]), ORIGIN)


@query
def yearly_weighted_change(spark: SparkSession, d: str) -> DataFrame:
    urgent = star.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    change = shares.yearly_change(urgent, [1999, 2000], "o_orderdate", F.col("o_custkey") % 7)
    return rounded(change, 6, "change")


def timed_periods(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("incident_date_time")
    return star.timed_calls(spark, d).select(
        period(ts, EVENTS_CUTOFF).alias("period"),
        week_of(ts).alias("week"),
        weekday_label(ts).alias("dow"),
        shift_band(ts).alias("shift"),
        F.hour(ts).alias("hour"),
        day_of(ts).alias("day"),
    )


@query
def dow_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile(timed_periods(spark, d), "dow")


@query
def dow_profile_wide(spark: SparkSession, d: str) -> DataFrame:
    return profiles.widen(dow_profile(spark, d), "dow", WEEKDAYS)


@query
def shift_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile(timed_periods(spark, d), "shift")


@query
def shift_profile_wide(spark: SparkSession, d: str) -> DataFrame:
    return profiles.widen(shift_profile(spark, d), "shift", SHIFTS)


@query
def hour_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile(timed_periods(spark, d), "hour")


@query
def hour_profile_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = profiles.widen(hour_profile(spark, d), "hour", range(24))
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in range(24)})


@query
def profile_bounds(spark: SparkSession, d: str) -> DataFrame:
    table = materialize(dow_profile(spark, d))
    return profiles.wide_with_bounds(table, "dow", WEEKDAYS, BEFORE, AFTER)


def area_period_averages(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("incident_date_time")
    calls = series.with_week(star.calls(spark, d, [AREA])).withColumn("period", period(ts, STUDY.cutoff))
    return profiles.average_by_area_period(calls, areas_of(spark, d), [BEFORE, AFTER])


@query
def avg_weekly_calls_by_area_period(spark: SparkSession, d: str) -> DataFrame:
    return rounded(area_period_averages(spark, d), 6, "avg_active_week")


# Areas, concentration, distributions


@query
def areas_per_decile(spark: SparkSession, d: str) -> DataFrame:
    return area_ops.areas_per_level(areas_of(spark, d))


@query
def area_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return area_ops.with_group_size(areas_of(spark, d))


@query
def dep_terciles(spark: SparkSession, d: str) -> DataFrame:
    return area_ops.deprivation_terciles(areas_of(spark, d)).select(
        AREA, "imd_rank", "dep_level"
    )


@query
def dep_level_weekly_share(spark: SparkSession, d: str) -> DataFrame:
    levels = area_ops.deprivation_terciles(areas_of(spark, d))
    counts = series.weekly_counts(star.calls(spark, d, [AREA, TYPE]).where(F.col(TYPE) == "Brand#10"), [AREA])
    located = area_ops.with_area(counts, levels.select(AREA, "dep_level"))
    weekly = located.groupBy("dep_level", "week").agg(F.sum("n").alias("n"))
    return rounded(shares.share_of_total(weekly, "n", ["week"], "per", 100.0), 9, "per")


@query
def area_pre_post(spark: SparkSession, d: str) -> DataFrame:
    counts = series.weekly_counts(star.calls(spark, d, [AREA]), [AREA])
    return area_ops.before_after(counts, areas_of(spark, d), STUDY.cutoff)


@query
def total_calls_by_area(spark: SparkSession, d: str) -> DataFrame:
    counts = area_ops.calls_by_area(star.calls(spark, d, [AREA]))
    return area_ops.with_area(counts, areas_of(spark, d)).where(F.col("imd_decile").isNotNull())


@query
def calls_by_area_type(spark: SparkSession, d: str) -> DataFrame:
    calls = star.calls(spark, d, [AREA, TYPE]).where(F.col(TYPE) == "Brand#10")
    return area_ops.all_areas_counted(areas_of(spark, d), area_ops.calls_by_area(calls))


@query
def gini_weekly(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(series.weekly_counts(star.calls(spark, d, [AREA]), [AREA]))
    total = star.table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    weekly = gini(ties(in_areas(counts, spark, d), ["week"]), ["week"], total)
    return rounded(series.fill_weeks(weekly, [], {"gini": None}, span=ends(counts)), 6, "gini")


@query
def gini_weekly_by_type(spark: SparkSession, d: str) -> DataFrame:
    calls = typed(star.calls(spark, d, [AREA, TYPE]))
    counts = materialize(series.weekly_counts(calls, ["incident_type_new", AREA]))
    total = star.table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    keys = ["incident_type_new", "week"]
    weekly = gini(ties(in_areas(counts, spark, d), keys), keys, total)
    filled = series.fill_weeks(weekly, ["incident_type_new"], {"gini": None}, span=ends(counts))
    return rounded(filled, 6, "gini")


def logged_area_totals(spark: SparkSession, d: str) -> DataFrame:
    return materialize(distribution.log10_positive(total_calls_by_area(spark, d), "n", "log_n"))


@query
def boxplot_by_decile(spark: SparkSession, d: str) -> DataFrame:
    box = distribution.boxplot(logged_area_totals(spark, d), ["imd_decile"], "log_n", 0.01)
    return rounded(box, 9, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def boxplot_outliers(spark: SparkSession, d: str) -> DataFrame:
    logged = logged_area_totals(spark, d)
    return distribution.boxplot_outliers(logged, ["imd_decile"], "log_n", 0.01).select(
        AREA, "imd_decile", "n"
    )


@query
def boxplot_by_decile_period(spark: SparkSession, d: str) -> DataFrame:
    averages = area_period_averages(spark, d).where(F.col("imd_decile").isNotNull())
    box = distribution.boxplot(materialize(averages), ["imd_decile", "period"], "avg_active_week", 0.25)
    return rounded(box, 9, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def boxplot_by_decile_type(spark: SparkSession, d: str) -> DataFrame:
    calls = typed(star.calls(spark, d, [AREA, TYPE]))
    counts = area_ops.with_area(area_ops.calls_by_area(calls, extra=[MERGED]), areas_of(spark, d))
    logged = distribution.log10_positive(counts.where(F.col("imd_decile").isNotNull()), "n", "log_n")
    box = distribution.boxplot(materialize(logged), [MERGED, "imd_decile"], "log_n", 0.01)
    return rounded(box, 9, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def boxplot_by_decile_period_type(spark: SparkSession, d: str) -> DataFrame:
    calls = typed(star.calls(spark, d, [AREA, TYPE]))
    label = period(F.col("incident_date_time"), STUDY.cutoff)
    weekly = series.with_week(calls).withColumn("period", label)
    ranked = areas_of(spark, d).where(F.col("imd_decile").isNotNull())
    averages = profiles.average_by_area_period(weekly, ranked, [BEFORE, AFTER], extra=[MERGED])
    box = distribution.boxplot(materialize(averages), [MERGED, "imd_decile", "period"], "avg_active_week", 0.25)
    return rounded(box, 9, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def duration_density(spark: SparkSession, d: str) -> DataFrame:
    timed = distribution.log10_positive(with_response(star.calls(spark, d, RESPONSE)), "minutes", "y")
    counted = materialize(timed.groupBy(F.lit("all").alias("calls"), "y").agg(n_rows()))
    return rounded(distribution.density(counted, ["calls"], "y", "n"), 6, "x", "density")


@query
def duration_density_by_grade(spark: SparkSession, d: str) -> DataFrame:
    timed = with_scene(star.calls(spark, d, [*SCENE, GRADE])).where(
        F.col(GRADE).isin(list(products.ATTENDED_GRADES))
    )
    label = period(F.col("incident_date_time"), STUDY.cutoff, "pre-pandemic", "pandemic", True)
    keyed = timed.withColumn("period", label).withColumn("y", pseudo_log(F.col("tos_minutes")))
    counted = materialize(keyed.groupBy(GRADE, "period", "y").agg(n_rows()))
    return rounded(distribution.density(counted, [GRADE, "period"], "y", "n"), 6, "x", "density")


@query
def decile_share_weekly(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(series.weekly_counts(star.calls(spark, d, [AREA]), [AREA]))
    share = shares.area_adjusted_share(counts, areas_of(spark, d), span=ends(counts))
    return rounded(rounded(share, 9, "share"), 6, "calls_per_area")


@query
def decile_share_weekly_by_type(spark: SparkSession, d: str) -> DataFrame:
    calls = typed(star.calls(spark, d, [AREA, TYPE]))
    counts = materialize(series.weekly_counts(calls, ["incident_type_new", AREA]))
    share = shares.area_adjusted_share(
        counts, areas_of(spark, d), extra=["incident_type_new"], span=ends(counts), keep_null=False
    )
    return rounded(rounded(share, 9, "share"), 6, "calls_per_area")


# Space


def area_values(spark: SparkSession, d: str) -> DataFrame:
    calls = area_ops.calls_by_area(star.calls(spark, d, [AREA]))
    return area_ops.all_areas_counted(star.table(spark, d, "supplier").select(F.col("s_suppkey").alias(AREA)), calls)


def lagged_values(spark: SparkSession, d: str) -> DataFrame:
    weights = moran.row_weights(materialize(geometry.queen_neighbours(star.layer(spark, d))))
    return materialize(moran.spatial_lag(area_values(spark, d), weights, "n"))


@query
def spatial_weights(spark: SparkSession, d: str) -> DataFrame:
    edges = materialize(geometry.queen_neighbours(star.layer(spark, d)))
    return rounded(moran.row_weights(edges), 6, "w")


@query
def spatial_lag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lagged_values(spark, d).select(AREA, "n", "lag"), 6, "lag")


@query
def moran_global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moran.moran_global(lagged_values(spark, d), "n"), 6, "moran_i", "kurtosis")


_LOCAL = ("z", "lag_z", "local_i", "expectation", "variance", "z_score")


@query
def moran_local(spark: SparkSession, d: str) -> DataFrame:
    local = moran.moran_local(lagged_values(spark, d), "n")
    return rounded(local.select(AREA, *_LOCAL), 5, *_LOCAL)


@query
def moran_local_total(spark: SparkSession, d: str) -> DataFrame:
    local = moran.moran_local(lagged_values(spark, d), "n", conditional=False)
    return rounded(local.select(AREA, *_LOCAL), 5, *_LOCAL)


@query
def moran_quadrants(spark: SparkSession, d: str) -> DataFrame:
    classed = moran.quadrants(moran.moran_local(lagged_values(spark, d), "n"))
    return classed.select(AREA, "n", "quadrant")


@query
def moran_p_values(spark: SparkSession, d: str) -> DataFrame:
    tested = moran.with_p_value(moran.moran_local(lagged_values(spark, d), "n"))
    classed = moran.quadrants(tested, F.col("p_value") <= 0.05)
    return rounded(classed.select(AREA, "p_value", "quadrant"), 6, "p_value")


@query
def area_z_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moran.standardize(materialize(area_values(spark, d)), "n", "z"), 6, "z")


# Forecasts


def model_series(weekly: DataFrame, key: str) -> DataFrame:
    """Trimmed and filled weekly counts, made durable for fit and comparison."""
    weekly = materialize(weekly)
    trimmed = series.trim_edges(weekly, [key], span=ends(weekly))
    return materialize(series.fill_weeks(trimmed, [key], {"n": 0}))


def grade_series(spark: SparkSession, d: str) -> DataFrame:
    return model_series(series.weekly_counts(star.calls(spark, d, [GRADE]), [GRADE]), GRADE)


def type_series(spark: SparkSession, d: str) -> DataFrame:
    return model_series(weekly_types(spark, d), "incident_type_new")


_BAND = ("actual", "mean", "lower", "upper")


def _grade_band(spark: SparkSession, d: str, method: str = "trend_ols", level: float = 95.0) -> DataFrame:
    return fc.forecast_band(grade_series(spark, d), [GRADE], "n", STUDY, method, level)


@query
def forecast_trend_band(spark: SparkSession, d: str) -> DataFrame:
    band = fc.forecast_band(type_series(spark, d), ["incident_type_new"], "n", STUDY, "trend_ols")
    return rounded(band, 6, *_BAND)


@query
def forecast_trend_band_99(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_grade_band(spark, d, level=99.0), 6, *_BAND)


@query
def actual_vs_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_grade_band(spark, d), 6, *_BAND)


@query
def trend_fitted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.trend_fitted(grade_series(spark, d), [GRADE], "n", STUDY), 6, "fitted")


@query
def report_slice(spark: SparkSession, d: str) -> DataFrame:
    sliced = fc.report_slice(_grade_band(spark, d), GRADE, ["Grade 1", "Grade 3"], STUDY)
    return rounded(sliced, 6, *_BAND)


@query
def sig_weeks_by_key(spark: SparkSession, d: str) -> DataFrame:
    band = fc.forecast_band(type_series(spark, d), ["incident_type_new"], "n", STUDY, "trend_ols")
    return fc.significant_weeks(band, ["incident_type_new"])


@query
def forecast_ar1_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_grade_band(spark, d, "trend_ar1"), 4, *_BAND)


@query
def forecast_harmonic_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_grade_band(spark, d, "harmonic_ols"), 4, *_BAND)


@query
def harmonic_fitted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.fitted_values(grade_series(spark, d), [GRADE], "n", STUDY, "harmonic_ols"), 4, "fitted")


@query
def forecast_gaps_band(spark: SparkSession, d: str) -> DataFrame:
    """Median response per type; weeks without an attended call stay unknown."""
    timed = with_response(typed(star.calls(spark, d, [*RESPONSE, TYPE])))
    medians = materialize(series.weekly_median(timed, "minutes", ["incident_type_new"]))
    filled = materialize(series.fill_weeks(medians, ["incident_type_new"], {"median": None}))
    return rounded(fc.forecast_band(filled, ["incident_type_new"], "median", STUDY, "trend_kalman"), 4, *_BAND)


@query
def order_choice(spark: SparkSession, d: str) -> DataFrame:
    chosen = orders.order_choice(fc.training(type_series(spark, d), STUDY), ["incident_type_new"], "n")
    return rounded(rounded(chosen, 6, "kpss"), 4, "criterion")


@query
def forecast_arima_band(spark: SparkSession, d: str) -> DataFrame:
    return fc.forecast_band(type_series(spark, d), ["incident_type_new"], "n", STUDY, "arima")


@query
def arima_fitted(spark: SparkSession, d: str) -> DataFrame:
    return fc.fitted_values(grade_series(spark, d), [GRADE], "n", STUDY)


@query
def smooth_weekly(spark: SparkSession, d: str) -> DataFrame:
    weekly = series.weekly_counts(star.calls(spark, d, [GRADE]), [GRADE])
    return rounded(smoothing.smooth(weekly, [GRADE], "n", 0.2), 4, "smoothed")


def product_inputs(spark: SparkSession, d: str) -> dict:
    calls = star.calls(spark, d, [TYPE, GRADE, ORIGIN, AREA, *RESPONSE, *SCENE])
    levels = materialize(area_ops.deprivation_terciles(areas_of(spark, d)))
    return {
        "calls": calls,
        "areas": levels.select(AREA, "dep_level"),
        "span": materialize(call_weeks(series.weekly_counts(star.calls(spark, d, [])))),
        "study": STUDY,
        "products": products.all_products(NAMES),
        "recode": products.Recode(TYPE_GROUPS, RARE_TYPES_BELOW, ORIGIN_GROUPS, UNKNOWN_ORIGINS),
    }


@query
def forecast_products(spark: SparkSession, d: str) -> DataFrame:
    band = products.forecast_products(**product_inputs(spark, d), method="trend_ols")
    return rounded(band, 3, *_BAND)


@query
def forecast_products_arima(spark: SparkSession, d: str) -> DataFrame:
    return products.forecast_products(**product_inputs(spark, d), method="arima")
