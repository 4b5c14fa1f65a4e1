"""The stored analyses from small CSV and polygon inputs."""

import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekband.plans import pipeline
from weekband.schema import Study
from weekband.sources.files import read_calls, read_results

TYPES = ["ASB", "Drugs", "Domestic Incident", "Missing Person", "Violence/Harassment", "RTC"]
STUDY = Study()


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("calls")
    rng = np.random.default_rng(8)
    start, days = dt.datetime(2017, 1, 2), 1500
    lines = [
        "incident_date_time,incident_type,call_origin,initial_grade_of_response,attended_flag,"
        "earliest_deployed_date_time,earliest_arrived_date_time,released_date_time,lsoa"
    ]
    for i in range(6000):
        at = start + dt.timedelta(days=float(rng.uniform(0, days)))
        at = at.replace(microsecond=0)
        arrive = at + dt.timedelta(minutes=int(rng.integers(1, 200)))
        leave = arrive + dt.timedelta(minutes=int(rng.integers(-5, 90)))
        origin = ["Helpdesk", "999", "Unknown Choice List Value", ""][i % 4]
        lines.append(
            f"{at},{TYPES[i % 6]},{origin},Grade {i % 5 + 1},{'1' if i % 3 else '0'},{at},{arrive},{leave},area {i % 7}"
        )
    (folder / "part.csv").write_text("\n".join(lines) + "\n")
    calls = pipeline.canonical(read_calls(spark, str(folder))).cache()
    areas = spark.createDataFrame(
        [(f"area {i}", i + 1, i % 3 + 1) for i in range(6)] + [("area 9", None, None)],
        "area_id string, imd_rank int, imd_decile int",
    )
    return calls, areas


def test_panels_are_complete_and_partitioned(spark, inputs, tmp_path):
    calls, areas = inputs
    pipeline.store_panels(calls, areas, str(tmp_path / "panels"), recode=pipeline.Recode(rare_below=10))
    panels = spark.read.parquet(str(tmp_path / "panels"))
    per_panel = rows(panels.groupBy("panel").agg(F.count("*"), F.count_distinct("area_id"), F.count_distinct("week")))
    assert len(per_panel) == 7
    assert {(a, n // w) for _, n, a, w in per_panel} == {(7, 7)}
    asb = panels.where("panel = 'asb'").agg(F.sum("n")).first()[0]
    assert asb == calls.where("incident_type = 'ASB' AND area_id <> 'area 6'").count()


def test_forecasts_are_stored_by_metric(spark, inputs, tmp_path):
    calls, areas = inputs
    path = str(tmp_path / "forecasts")
    pipeline.store_forecasts(calls, areas, STUDY, path, "trend_ols", recode=pipeline.Recode(rare_below=10))
    stored = read_results(spark, path)
    assert stored.select("metric").distinct().count() == 20
    assert {r[0] for r in stored.where("mean IS NOT NULL").groupBy("metric", "key_value").count().select("count").distinct().collect()} == {48}
    origins = {r[0] for r in read_results(spark, path, "calls by origin").select("key_value").distinct().collect()}
    assert origins == {"public non-emergency", "999", None}
    shares = read_results(spark, path, "asb share by deprivation").where("actual IS NOT NULL")
    totals = shares.groupBy("week").agg(F.sum("actual").alias("s"))
    assert totals.where("abs(s - 100) > 1e-6").count() == 0


def test_deprivation_report(spark, inputs):
    calls, areas = inputs
    report = pipeline.deprivation_report(calls, areas, STUDY, {"asb": ["ASB"], "rtc": ["RTC"]}, "incident_type")
    totals = {r["imd_decile"]: r["n"] for r in report["totals"].collect()}
    assert totals == {1: 2, 2: 2, 3: 2}
    assert report["before_after"].count() == 6
    by_week = report["weekly_share"].groupBy("type", "week").agg(F.sum("share").alias("s"), F.count("*").alias("k"))
    assert by_week.where("k <> 4 OR (s IS NOT NULL AND abs(s - 1) > 1e-9)").count() == 0
    by_type = report["totals_by_type"].collect()
    assert {r["type"] for r in by_type} <= {"asb", "rtc"} and all(r["n"] <= 2 for r in by_type)
    assert report["before_after_by_type"].count() == 12
    one_table = pipeline.deprivation_report(calls, areas, STUDY)["weekly_share"]
    known = calls.where("area_id <> 'area 6'")
    assert one_table.agg(F.sum("n")).first()[0] < known.count()


def test_layer_keeps_areas_without_deprivation(spark):
    def square(x, y):
        return [[(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]]

    shape = "string, rings array<array<struct<x: double, y: double>>>"
    boundary = spark.createDataFrame([("force", square(0.5, 0.5))], f"boundary_id {shape}")
    layer = spark.createDataFrame(
        [("a", square(0.0, 0.0)), ("b", square(1.0, 1.0)), ("c", square(1.0, 0.0)), ("d", square(7.0, 7.0))],
        f"area_id {shape}",
    )
    sheet = spark.createDataFrame([("a", 5), ("d", 6)], "area_id string, imd_rank int")
    listed = spark.createDataFrame([("a",), ("b",), ("d",)], "area_id string")
    built = pipeline.build_layer(boundary, layer, sheet, 2.0, listed)
    assert rows(built, "area_id", "imd_rank") == [("a", 5), ("b", None)]


def test_trim_modes_of_products(spark):
    """Three keys over four weeks: each mode leaves its own rows."""
    import datetime as dt

    from weekband.plans.products import Product, trimmed

    weeks = [dt.date(2020, 1, 6) + dt.timedelta(7 * i) for i in range(4)]
    rows_in = [(m, "k", key, w, 1.0) for m in "abcd" for key in "xyz" for w in weeks]
    table = spark.createDataFrame(rows_in, "metric string, key_name string, key_value string, week date, value double")
    span = spark.createDataFrame([(weeks[0], weeks[-1])], "lo date, hi date")
    modes = dict(a="edge_weeks", b="none", c="table_rows", d="group_rows")
    chosen = [Product(m, "count", trim=mode) for m, mode in modes.items()]
    left = {(r["metric"], r["key_value"], r["week"]) for r in trimmed(table, span, chosen).collect()}
    expected = {(m, key, w) for m in "abcd" for key in "xyz" for w in weeks}
    expected -= {("a", key, w) for key in "xyz" for w in (weeks[0], weeks[-1])}
    expected -= {("c", "x", weeks[0]), ("c", "z", weeks[-1])} | {("d", key, w) for key in "xz" for w in weeks}
    assert left == expected
