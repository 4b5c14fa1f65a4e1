"""The twenty forecast products as one table of weekly series.

Calls are reduced three times, to volume, to durations and to areas, at the finest grain any
product needs. Each reduced row then contributes to every product it belongs to, so twenty
products cost three passes over the calls instead of twenty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.functions.durations import minutes_between, repair_half_day
from weekband.functions.recode import (
    ORIGIN_GROUPS,
    TYPE_GROUPS,
    UNKNOWN_ORIGINS,
    merge_categories,
    merge_origins,
)
from weekband.operators.common import any_of, join_on_keys
from weekband.operators.concentration import gini, ties
from weekband.operators.forecast import forecast_band
from weekband.operators.quantiles import median
from weekband.operators.series import fill_weeks, percent, trim_edges, with_week
from weekband.operators.shares import share_of_total
from weekband.schema import Study
from weekband.session import materialize

TYPE, GRADE, ORIGIN, LEVEL = (
    "incident_type_new",
    "initial_grade_of_response",
    "call_origin",
    "dep_level",
)
ATTENDED_GRADES = ("Grade 1", "Grade 2", "Grade 3", "Grade 4")
SERIES_KEYS = ["metric", "key_name", "key_value"]


@dataclass(frozen=True)
class Product:
    """One forecast product: what is measured, over which calls, per which key."""

    metric: str
    measure: str
    key: str | None = None
    types: tuple[str, ...] = ()
    grades: tuple[str, ...] = ()
    fill: float | None = 0.0
    #: How incomplete weeks are dropped: a mode of `trim_edges`, or `none`.
    trim: str = "edge_weeks"

    def covers(self) -> Column:
        conditions = [F.lit(True)]
        if self.types:
            conditions.append(F.col(TYPE).isin(list(self.types)))
        if self.grades:
            conditions.append(F.col(GRADE).isin(list(self.grades)))
        return reduce(Column.__and__, conditions)


@dataclass(frozen=True)
class Names:
    """The type labels that single-type products refer to."""

    domestic: str = "Domestic Incident"
    asb: str = "ASB"
    drugs: str = "Drugs"
    violence: str = "Violence/Harassment"
    missing: str = "Missing Person"
    admin: str = "Advice/Directions/Admin"


def all_products(names: Names = Names()) -> list[Product]:
    dv = (names.domestic,)
    return [
        Product("calls", "count"),
        Product("calls by type", "count", TYPE),
        Product("domestic calls by grade", "count", GRADE, dv),
        Product("calls by origin", "count", ORIGIN),
        Product("asb share by deprivation", "share", LEVEL, (names.asb,)),
        Product("attended", "attended", fill=None),
        Product("attended by type", "attended", TYPE),
        Product("attended by grade", "attended", GRADE, grades=ATTENDED_GRADES),
        Product("domestic attended by grade", "attended", GRADE, dv, ATTENDED_GRADES),
        Product("response time", "response", fill=None),
        Product("response time by type", "response", TYPE, fill=None),
        Product("response time by grade", "response", GRADE, fill=None),
        Product("domestic response time by grade", "response", GRADE, dv, fill=None),
        Product("time on scene by grade", "scene", GRADE, grades=ATTENDED_GRADES, fill=None),
        Product("gini", "gini", fill=None),
        Product("gini asb", "gini", types=(names.asb,), fill=None),
        Product("gini drugs", "gini", types=(names.drugs,), fill=None),
        Product("gini violence", "gini", types=(names.violence,), fill=None),
        Product("gini domestic", "gini", types=dv, fill=None),
        Product("gini missing person", "gini", types=(names.missing,), fill=None),
    ]


@dataclass(frozen=True)
class Recode:
    """How raw types and origins are merged."""

    types: Mapping[str, Sequence[str]] = field(default_factory=lambda: TYPE_GROUPS)
    rare_below: int = 1000
    origins: Mapping[str, Sequence[str]] = field(default_factory=lambda: ORIGIN_GROUPS)
    unknown_origins: Sequence[str] = UNKNOWN_ORIGINS


def _contributions(
    reduced: DataFrame, products: Sequence[Product], *also: Column
) -> DataFrame:
    """Reduced rows repeated once per product that covers them.

    Adds `product`, the place of the product in the list, and `key_value`. A small number is
    cheaper to shuffle and sort than the metric's name, which `_named` puts back. `also` holds one
    more condition per product, if any.
    """
    extra = also or [F.lit(True)] * len(products)
    hits = F.array(
        *(
            F.when(
                p.covers() & condition,
                F.struct(
                    F.lit(i).cast("short").alias("product"),
                    (F.lit(None) if p.key is None else F.col(p.key)).cast("string").alias("key_value"),
                ),
            )
            for i, (p, condition) in enumerate(zip(products, extra))
        )
    )
    return reduced.withColumn("_to", F.explode(F.array_compact(hits))).select("*", "_to.*").drop("_to")


def _look_up(products: Sequence[Product], attribute: str) -> Column:
    names = F.array(*(F.lit(getattr(p, attribute)).cast("string") for p in products))
    return F.get(names, F.col("product").cast("int"))


def _named(series: DataFrame, products: Sequence[Product]) -> DataFrame:
    """(metric, key_name, key_value, week, value) from numbered products."""
    return series.select(
        _look_up(products, "metric").alias("metric"),
        _look_up(products, "key").alias("key_name"),
        "key_value",
        "week",
        "value",
    )


def _pick(products: Sequence[Product], *measures: str) -> list[Product]:
    return [p for p in products if p.measure in measures]


def _recoded(reduced: DataFrame, recode: Recode, rare: DataFrame) -> DataFrame:
    """Reduced rows with merged types; `rare` is (incident_type, is_rare), one row per raw type."""
    flagged = join_on_keys(reduced, rare, ["incident_type"], "left")
    return flagged.withColumn(
        TYPE, merge_categories(F.col("incident_type"), recode.types, F.col("is_rare"))
    ).drop("incident_type", "is_rare")


def volume_cube(calls: DataFrame) -> DataFrame:
    """Calls and attended calls per week, raw type, grade and raw origin: small at any volume."""
    return (
        with_week(calls)
        .groupBy("week", "incident_type", GRADE, ORIGIN)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("attended_flag"), F.lit(0)).cast("bigint").alias("attended"),
        )
    )


def rare_types(cube: DataFrame, recode: Recode) -> DataFrame:
    """(incident_type, is_rare) for every raw type."""
    return cube.groupBy("incident_type").agg((F.sum("n") < recode.rare_below).alias("is_rare"))


def volume_series(
    cube: DataFrame, rare: DataFrame, products: Sequence[Product], recode: Recode
) -> DataFrame:
    """Counts and attendance rates. Only products keyed by origin need the origin kept apart."""
    merged = _recoded(cube, recode, rare).withColumn(
        ORIGIN, merge_origins(F.col(ORIGIN), recode.origins, recode.unknown_origins)
    )
    wanted = _pick(products, "count", "attended")
    parts = []
    for columns, chosen in (
        ([TYPE, GRADE], [p for p in wanted if p.key != ORIGIN]),
        ([TYPE, GRADE, ORIGIN], [p for p in wanted if p.key == ORIGIN]),
    ):
        if not chosen:
            continue
        summed = (F.sum("n").alias("n"), F.sum("attended").alias("attended"))
        reduced = merged.groupBy("week", *columns).agg(*summed)
        sums = _contributions(reduced, chosen).groupBy("product", "key_value", "week").agg(*summed)
        value = F.when(_look_up(chosen, "measure") == "count", F.col("n").cast("double")).otherwise(
            percent(F.col("attended"), F.col("n"))
        )
        parts.append(_named(sums.withColumn("value", value), chosen))
    return reduce(DataFrame.unionByName, parts)


def duration_series(
    calls: DataFrame,
    rare: DataFrame,
    products: Sequence[Product],
    recode: Recode,
    negative_scene: bool = False,
) -> DataFrame:
    """Median response time and time on scene of attended calls, in minutes.

    Both durations of a call are counted in one pass. Negative times on scene are set aside unless
    `negative_scene`; negative response times are repaired.
    """
    attended = with_week(calls.where(F.col("attended_flag") == 1))
    response = repair_half_day(
        minutes_between(F.col("earliest_deployed_date_time"), F.col("earliest_arrived_date_time"))
    )
    scene = minutes_between(F.col("earliest_arrived_date_time"), F.col("released_date_time"))
    if not negative_scene:
        scene = F.when(scene >= 0, scene)
    kinds = F.array(
        F.struct(F.lit("response").alias("kind"), response.alias("minutes")),
        F.struct(F.lit("scene").alias("kind"), scene.alias("minutes")),
    )
    counted = (
        attended.select("week", "incident_type", GRADE, F.explode(kinds).alias("_k"))
        .select("week", "incident_type", GRADE, "_k.*")
        .groupBy("week", "incident_type", GRADE, "kind", "minutes")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    wanted = _pick(products, "response", "scene")
    # A product takes only its own kind of duration.
    own_kind = (F.col("kind") == p.measure for p in wanted)
    rows = _contributions(_recoded(counted, recode, rare), wanted, *own_kind)
    found = median(rows, ["product", "key_value", "week"], "minutes", 60.0, weight="m")
    return _named(found.withColumnRenamed("median", "value"), wanted)


def area_ties(
    calls: DataFrame, rare: DataFrame, areas: DataFrame, products: Sequence[Product], recode: Recode
) -> DataFrame:
    """(metric, week, level, known, x, m): how many areas have `x` calls in a week.

    The one table that concentration and deprivation shares are computed from. Its size does not
    depend on the number of areas. `known` tells listed areas from all others.
    """
    counted = (
        with_week(calls)
        .groupBy("week", "incident_type", "area_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # These products have no grade filter, and shares get their key from the area.
    wanted = [replace(p, key=None) for p in _pick(products, "gini", "share")]
    rows = (
        _contributions(_recoded(counted, recode, rare), wanted)
        .groupBy("product", "week", "area_id")
        .agg(F.sum("n").alias("n"))
    )
    listed = areas.select("area_id", LEVEL, F.lit(True).alias("known"))
    tied = ties(rows.join(listed, "area_id", "left"), ["product", "week", LEVEL, "known"])
    return tied.withColumn("metric", _look_up(wanted, "metric")).drop("product")


def gini_series(
    tied: DataFrame, areas: DataFrame, span: DataFrame, products: Sequence[Product]
) -> DataFrame:
    """Gini over all areas for every week of the span, NULL in a week without calls."""
    metrics = [p.metric for p in _pick(products, "gini")]
    merged = (
        tied.where(F.col("known") & F.col("metric").isin(metrics))
        .groupBy("metric", "week", "x")
        .agg(F.sum("m").alias("m"))
    )
    total = areas.agg(F.count(F.lit(1))).scalar()
    weekly = gini(merged, ["metric", "week"], total)
    ends = (span.select("lo").scalar(), span.select("hi").scalar())
    return fill_weeks(weekly, ["metric"], {"gini": None}, span=ends).select(
        "metric",
        F.lit(None).cast("string").alias("key_name"),
        F.lit(None).cast("string").alias("key_value"),
        "week",
        F.col("gini").alias("value"),
    )


def share_series(tied: DataFrame, products: Sequence[Product]) -> DataFrame:
    """Percent of the week's calls per level; calls of unlevelled areas are a level of their own."""
    sums = (
        tied.where(F.col("metric").isin([p.metric for p in _pick(products, "share")]))
        .groupBy("metric", LEVEL, "week")
        .agg(F.sum(F.col("x") * F.col("m")).alias("n"))
    )
    return share_of_total(sums, "n", ["metric", "week"], "value", 100.0).select(
        "metric", F.lit(LEVEL).alias("key_name"), F.col(LEVEL).alias("key_value"), "week", "value"
    )


def trimmed(series: DataFrame, span: DataFrame, products: Sequence[Product]) -> DataFrame:
    """Each product without its incomplete weeks. Only the modes that slice rows need a pass of their own per product."""
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    by_mode: dict[str, list[str]] = {}
    for p in products:
        by_mode.setdefault(p.trim, []).append(p.metric)
    if set(by_mode) - {"edge_weeks", "none"}:
        series = materialize(series)
    parts = []
    for mode, metrics in by_mode.items():
        if mode == "none":
            parts.append(series.where(F.col("metric").isin(metrics)))
        elif mode == "edge_weeks":
            chosen = series.where(F.col("metric").isin(metrics))
            parts.append(trim_edges(chosen, SERIES_KEYS, span=(lo, hi)))
        else:
            parts += [trim_edges(series.where(F.col("metric") == m), ["key_value"], mode) for m in metrics]
    return reduce(DataFrame.unionByName, parts)


def product_series(
    calls: DataFrame,
    areas: DataFrame,
    span: DataFrame,
    products: Sequence[Product],
    recode: Recode = Recode(),
    negative_scene: bool = False,
) -> DataFrame:
    """All series in one table (metric, key_name, key_value, week, value), trimmed and filled.

    `areas` is (area_id, dep_level); `span` is (lo, hi), the first and last week of the data,
    both of which may be incomplete and are dropped.
    """
    cube = materialize(volume_cube(calls))
    rare = materialize(rare_types(cube, recode))
    parts = []
    if _pick(products, "count", "attended"):
        parts.append(volume_series(cube, rare, products, recode))
    if _pick(products, "response", "scene"):
        parts.append(duration_series(calls, rare, products, recode, negative_scene))
    if _pick(products, "gini", "share"):
        tied = materialize(area_ties(calls, rare, areas, products, recode))
        parts += [gini_series(tied, areas, span, products), share_series(tied, products)]
    series = reduce(DataFrame.unionByName, parts)
    filled = fill_weeks(trimmed(series, span, products).withColumn("_real", F.lit(True)), SERIES_KEYS, {"value": None, "_real": False})
    zero = any_of([F.col("metric") == p.metric for p in products if p.fill is not None])
    value = F.when(zero & ~F.col("_real"), F.lit(0.0)).otherwise(F.col("value"))
    return filled.select(*SERIES_KEYS, "week", value.alias("value"))


def forecast_products(
    calls: DataFrame,
    areas: DataFrame,
    span: DataFrame,
    study: Study,
    products: Sequence[Product] | None = None,
    recode: Recode = Recode(),
    method: str = "arima",
    level: float = 95.0,
    negative_scene: bool = False,
) -> DataFrame:
    """The long result table of all products: actual, band and flag per series and week."""
    chosen = all_products() if products is None else products
    series = materialize(product_series(calls, areas, span, chosen, recode, negative_scene))
    return forecast_band(series, SERIES_KEYS, "value", study, method, level)
