import datetime as dt
import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import types as T

from weekband.sources import files

HEADER = (
    "incident_date_time,incident_type,call_origin,initial_grade_of_response,attended_flag,"
    "earliest_deployed_date_time,earliest_arrived_date_time,released_date_time,lsoa\n"
)


def test_read_gzip_calls(spark, tmp_path):
    path = tmp_path / "calls.csv.gz"
    with gzip.open(path, "wt") as out:
        out.write(HEADER)
        out.write("2020-01-06 10:11:12,ASB,,Grade 1,1,2020-01-06 10:12:00,2020-01-06 10:20:30,,Area 1\n")
    row = files.read_calls(spark, str(path)).first()
    assert row["incident_date_time"] == dt.datetime(2020, 1, 6, 10, 11, 12)
    assert row["call_origin"] is None and row["released_date_time"] is None
    assert row["attended_flag"] == 1 and row["lsoa"] == "Area 1"


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Index of Multiple Deprivation (IMD) Rank", "index_of_multiple_deprivation_imd_rank"),
        ("LSOA name (2011)", "lsoa_name_2011"),
        ("95%", "x95_percent"),
        ("incidentType", "incident_type"),
        (" .fitted", "fitted"),
    ],
)
def test_clean_name(raw, clean):
    assert files.clean_name(raw) == clean


def test_clean_names_are_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a_b` int, `A-B` int")
    assert files.clean_names(df).columns == ["a_b", "a_b_2", "a_b_3"]


def test_named_csv(spark, tmp_path):
    (tmp_path / "imd.csv").write_text("LSOA name (2011),IMD Rank\nArea 1,7\n")
    assert rows(files.read_named_csv(spark, str(tmp_path / "imd.csv")), "lsoa_name_2011", "imd_rank") == [("Area 1", 7)]


def test_stack_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2,)], "i int")
    assert rows(files.stack(a, b), "i", "s") == [(1, "x"), (2, None)]


def feature(name, kind, coordinates):
    return {"type": "Feature", "properties": {"name": name}, "geometry": {"type": kind, "coordinates": coordinates}}


OUTER = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]


@pytest.mark.parametrize("lines", [False, True])
def test_geojson_polygons_and_multipolygons(spark, tmp_path, lines):
    features = [feature("a", "Polygon", [OUTER, HOLE]), feature("b", "MultiPolygon", [[OUTER], [HOLE]])]
    path = tmp_path / "layer.json"
    if lines:
        path.write_text("\n".join(json.dumps(f) for f in features))
    else:
        path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    properties = T.StructType([T.StructField("name", T.StringType())])
    layer = files.read_geojson(spark, str(path), properties, lines)
    got = {r["name"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in layer.collect()}
    expected = [[tuple(p) for p in OUTER], [tuple(p) for p in HOLE]]
    assert got == {"a": expected, "b": expected}


PLACEMARK = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://earth.google.com/kml/2.1"><Document>
  <Placemark><name>grouped</name>
    <MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 4,0,0
      4,4,0 0,0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry>
  </Placemark>
  <Placemark><name>single</name>
    <Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 9,0,0 9,9,0</coordinates></LinearRing></outerBoundaryIs>
    <innerBoundaryIs><LinearRing><coordinates>5,1,0 6,1,0 6,2,0</coordinates></LinearRing></innerBoundaryIs></Polygon>
  </Placemark>
</Document></kml>"""


def test_kml(spark, tmp_path):
    path = tmp_path / "boundary.kml"
    path.write_text(PLACEMARK)
    got = {r["name"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in files.read_kml(spark, str(path)).collect()}
    assert got == {
        "grouped": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]],
        "single": [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], [(5.0, 1.0), (6.0, 1.0), (6.0, 2.0)]],
    }


def test_result_store_replaces_only_its_metrics(spark, tmp_path):
    path = str(tmp_path / "band")
    schema = "metric string, week date, mean double"
    week = dt.date(2020, 1, 27)
    files.write_results(spark.createDataFrame([("a", week, 1.0), ("b", week, 2.0)], schema), path)
    files.write_results(spark.createDataFrame([("b", week, 9.0)], schema), path)
    assert rows(files.read_results(spark, path), "metric", "mean") == [("a", 1.0), ("b", 9.0)]
    assert rows(files.read_results(spark, path, "a"), "metric", "mean") == [("a", 1.0)]


def test_layer_and_csv_sinks(spark, tmp_path):
    layer = spark.createDataFrame(
        [(1, [[(0.0, 0.0), (1.0, 0.0)]])], "area_id long, rings array<array<struct<x: double, y: double>>>"
    )
    files.write_layer(layer, str(tmp_path / "layer"))
    assert spark.read.parquet(str(tmp_path / "layer")).collect() == layer.collect()
    files.write_csv(layer.select("area_id"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["area_id"] == "1"
