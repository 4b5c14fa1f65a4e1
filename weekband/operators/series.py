"""Weekly and daily series: counts, rates, medians, edge trimming, gap filling, regressors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekband.functions.calendar import after_week_of, day_of, is_holiday_week, week_of
from weekband.functions.durations import round_half_even
from weekband.operators.common import by, join_on_keys
from weekband.operators.quantiles import median
from weekband.schema import Study

EVENT_TIME = "incident_date_time"


def with_week(calls: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    return calls.withColumn("week", week_of(F.col(ts)))


def weekly_counts(calls: DataFrame, keys: Sequence[str] = (), ts: str = EVENT_TIME) -> DataFrame:
    """(keys, week, n); NULL keys form a group."""
    return with_week(calls, ts).groupBy(*keys, "week").agg(F.count(F.lit(1)).alias("n"))


def weekly_series(calls: DataFrame, types: Sequence[str], type_col: str = "incident_type") -> DataFrame:
    """Weekly count of all calls whose type is one of `types`."""
    return weekly_counts(calls.where(F.col(type_col).isin(list(types))))


def daily_counts(calls: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    return calls.groupBy(day_of(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal, ties to even; NULL for an empty whole."""
    ratio = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    return round_half_even(ratio * F.lit(100.0), 1)


def weekly_attendance(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, week, n, attended, percent_attended); calls without a flag count in `n`."""
    return (
        with_week(calls)
        .groupBy(*keys, "week")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("attended_flag"), F.lit(0)).cast("bigint").alias("attended"),
        )
        .withColumn("percent_attended", percent(F.col("attended"), F.col("n")))
    )


def weekly_median(
    calls: DataFrame, value: str, keys: Sequence[str] = (), width: float = 60.0
) -> DataFrame:
    """(keys, week, median) of `value`."""
    return median(with_week(calls), [*keys, "week"], value, width).drop("n")


def trim_edges(
    series: DataFrame,
    keys: Sequence[str] = (),
    mode: str = "edge_weeks",
    span: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Drop incomplete weeks at both ends.

    `edge_weeks` drops the first and last week of the data for every key. `table_rows` drops only
    the first and last row of the key-sorted table, `group_rows` the first and last key within each
    week. The last two keep a table or group of fewer than three rows, as row slicing does.

    `span` gives the first and last week of the data. Without it, and in `table_rows`, the series
    is read twice: pass one that is materialised or cheap.
    """
    if mode == "edge_weeks":
        if span is None:
            ends = series.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
            span = ends.select("lo").scalar(), ends.select("hi").scalar()
        return series.where((F.col("week") > span[0]) & (F.col("week") < span[1]))
    if mode == "table_rows":
        if not keys:
            spot = F.struct("week")
        else:
            spot = F.struct(*(f for k in keys for f in (F.col(k).isNull().alias(f"_{k}"), F.col(k))), "week")
        spotted = series.withColumn("_spot", spot)
        ends = spotted.agg(
            F.min("_spot").alias("lo"), F.max("_spot").alias("hi"), F.count(F.lit(1)).alias("rows")
        )
        inner = (~F.col("_spot").eqNullSafe(ends.select("lo").scalar())) & (
            ~F.col("_spot").eqNullSafe(ends.select("hi").scalar())
        )
        return spotted.where(inner | (ends.select("rows").scalar() < 3)).drop("_spot")
    if mode == "group_rows":
        week = Window.partitionBy("week")
        ordered = week.orderBy(*(F.asc_nulls_last(k) for k in keys))
        return (
            series.withColumn("_at", F.row_number().over(ordered))
            .withColumn("_of", F.count(F.lit(1)).over(week))
            .where((F.col("_of") < 3) | ((F.col("_at") > 1) & (F.col("_at") < F.col("_of"))))
            .drop("_at", "_of")
        )
    raise ValueError(f"unknown mode {mode!r}")


def week_grid(lo: Column, hi: Column) -> Column:
    """Array of all weeks from `lo` to `hi`."""
    return F.sequence(lo, hi, F.expr("interval 7 days"))


def fill_weeks(
    series: DataFrame,
    keys: Sequence[str],
    fills: Mapping[str, object],
    carry: Sequence[str] = (),
    span: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Insert the missing weeks of each key.

    Without `span` a key is filled between its own first and last week; with it, over the whole
    span, and a key whose only row has a NULL week gets all of it. New rows hold `fills` for the
    listed measures, the key's own value for `carry`, and NULL for any other column. Each row is
    expanded up to the next one, so the keys are shuffled once and no grid is joined.
    """
    ordered = by(keys).orderBy("week")
    until = F.date_sub(F.lead("week").over(ordered), 7)
    if span is None:
        start, stop = F.col("week"), F.coalesce(until, F.col("week"))
    else:
        start = F.when(F.row_number().over(ordered) == 1, span[0]).otherwise(F.col("week"))
        stop = F.coalesce(until, span[1])
    expanded = series.withColumn("_start", start).withColumn("_stop", stop)
    expanded = expanded.withColumn("_week", F.explode(week_grid(F.col("_start"), F.col("_stop"))))
    own = F.col("_week") == F.col("week")
    measures = [c for c in series.columns if c not in {*keys, *carry, "week"}]
    return expanded.select(
        *keys,
        *carry,
        F.col("_week").alias("week"),
        *(F.when(own, F.col(m)).otherwise(F.lit(fills.get(m))).alias(m) for m in measures),
    )


def add_regressors(series: DataFrame, study: Study) -> DataFrame:
    """Intervention and bank-holiday dummies by week."""
    week = F.col("week")
    return series.withColumns(
        {
            "new_system": after_week_of(week, study.new_system),
            "hmic_changes": after_week_of(week, study.hmic_changes),
            "bank_holiday": is_holiday_week(week, study.holiday_years),
        }
    )


def future_frame(keys_of: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    """One row per distinct key and horizon week; both interventions are in force."""
    weeks = F.array(*(F.lit(w) for w in study.horizon_weeks()))
    distinct = keys_of.select(*keys).distinct() if keys else keys_of.sparkSession.range(1)
    return distinct.select(
        *keys,
        F.explode(weeks).alias("week"),
    ).withColumns(
        {
            "new_system": F.lit(True),
            "hmic_changes": F.lit(True),
            "bank_holiday": is_holiday_week(F.col("week"), [study.cutoff.year]),
        }
    )


def key_date_table(like: DataFrame, study: Study) -> DataFrame:
    """Key dates aligned to their week, numbered in the given order and labelled."""
    rows = [(i, day, event) for i, (day, event) in enumerate(study.key_dates, start=1)]
    table = like.sparkSession.createDataFrame(rows, "row int, day date, event string")
    return table.select(
        "row",
        F.trunc("day", "week").alias("week"),
        "event",
        F.concat_ws(". ", F.col("row").cast("string"), "event").alias("label"),
    )


def with_key_dates(series: DataFrame, study: Study) -> DataFrame:
    """Series with the joined labels of the key dates that fall in each week, NULL elsewhere."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "label")))
    labels = (
        key_date_table(series, study)
        .groupBy("week")
        .agg(F.array_join(F.transform(ordered, lambda s: s.label), "; ").alias("events"))
    )
    return join_on_keys(series, F.broadcast(labels), ["week"], "left")
