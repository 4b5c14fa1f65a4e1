"""Sources and sinks over the given tables: what is written is read back and summed up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekband.plans.oracle import AREAS, CALLS, _sql
from weekband.schema import CALLS as CALL_SCHEMA
from weekband.session import shared_folder
from weekband.sources import files
from weekband.sources import star_tables as star


def _week() -> Column:
    return F.trunc(F.col("incident_date_time").cast("date"), "week").alias("week")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _raw_calls(spark: SparkSession, d: str) -> DataFrame:
    wanted = [f.name for f in CALL_SCHEMA.fields if f.name != "lsoa"] + ["area_id"]
    calls = star.calls(spark, d, wanted)
    return calls.select(*wanted[:-1], F.col("area_id").cast("string").alias("lsoa")).select(
        *(F.col(f.name).cast(f.dataType) for f in CALL_SCHEMA.fields)
    )


def calls_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Calls written as CSV and read with their schema."""
    path = _folder(spark)
    files.write_csv(_raw_calls(spark, d), path)
    calls = files.read_calls(spark, path)
    return calls.groupBy("initial_grade_of_response", _week()).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("attended_flag").cast("long").alias("attended"),
        F.count("call_origin").alias("with_origin"),
        F.count_distinct("lsoa").alias("areas"),
    )


def stacked_parts(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of the calls, one without the column of origins."""
    path = _folder(spark)
    calls = _raw_calls(spark, d)
    attended = F.col("attended_flag") == 1
    files.write_csv(calls.where(attended), f"{path}/a")
    files.write_csv(calls.where(~attended).drop("call_origin"), f"{path}/b")
    short = T.StructType([f for f in CALL_SCHEMA.fields if f.name != "call_origin"])
    both = files.stack(files.read_calls(spark, f"{path}/a"), files.read_calls(spark, f"{path}/b", short))
    return both.groupBy("call_origin", "attended_flag").agg(F.count(F.lit(1)).alias("n"))


def attribute_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The area attributes as a sheet with headings for people, read back with clean names."""
    path = _folder(spark)
    areas = star.areas(spark, d).select(
        F.col("area_id").alias("Area ID"), F.col("imd_rank").alias("IMD-Rank (#)"), F.col("imd_decile").alias("imdDecile")
    )
    files.write_csv(areas, path)
    return files.read_named_csv(spark, path).select(*(F.col(c).cast("long").alias(c) for c in ("area_id", "imd_rank_number", "imd_decile")))


def _corners(rings: DataFrame, key: str) -> DataFrame:
    points = rings.select(key, F.explode(F.flatten("rings")).alias("p"))
    return points.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.min("p.x").alias("x"), F.max("p.y").alias("y")
    )


def layer_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The layer as one GeoJSON feature per line, and back."""
    path = _folder(spark)
    coordinates = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("area_id").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )
    star.layer(spark, d).select(F.to_json(feature)).write.text(path)
    properties = T.StructType([T.StructField("area_id", T.LongType())])
    return _corners(files.read_geojson(spark, path, properties, lines=True), "area_id")


def layer_kml(spark: SparkSession, d: str) -> DataFrame:
    """The layer as KML documents of a thousand placemarks, and back."""
    path = _folder(spark)
    triples = F.array_join(F.transform(F.col("rings")[0], lambda p: F.concat_ws(",", p["x"], p["y"], F.lit("0"))), " ")
    around = "<Polygon><outerBoundaryIs><LinearRing><coordinates>%s</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    row = F.format_string(f"<Placemark><name>%s</name>{around}</Placemark>", F.col("area_id").cast("string"), triples)
    placemarks = star.layer(spark, d).select(F.floor(F.col("area_id") / 1000).alias("part"), row.alias("p"))
    body = F.array_join(F.collect_list("p"), "\n")
    document = F.concat(F.lit("<kml><Document>\n"), body, F.lit("\n</Document></kml>"))
    placemarks.groupBy("part").agg(document.alias("value")).write.partitionBy("part").text(path)
    found = files.read_kml(spark, path).withColumn("area_id", F.col("name").cast("long"))
    return _corners(found, "area_id")


def result_store(spark: SparkSession, d: str) -> DataFrame:
    """Two metrics stored, one of them replaced, both read back."""
    path = _folder(spark)
    weekly = _raw_calls(spark, d).groupBy(_week()).agg(
        F.count(F.lit(1)).cast("double").alias("calls"), F.count_if(F.col("attended_flag") == 1).cast("double").alias("attended")
    )
    one = lambda metric, value: weekly.select("week", value.alias("value"), F.lit(metric).alias("metric"))
    files.write_results(one("calls", F.lit(0.0)).unionByName(one("attended", F.col("attended"))), path)
    files.write_results(one("calls", F.col("calls")), path)
    return files.stack(files.read_results(spark, path, "calls"), files.read_results(spark, path, "attended"))


def layer_store(spark: SparkSession, d: str) -> DataFrame:
    """The layer with its nested rings, written and read."""
    path = _folder(spark)
    files.write_layer(star.layer(spark, d), path)
    return _corners(spark.read.parquet(path), "area_id")


QUERIES = {
    f.__name__: f
    for f in (
        calls_csv_round_trip, stacked_parts, attribute_sheet, layer_geojson, layer_kml, result_store, layer_store,
    )
}

_SQUARES = """
SELECT s_suppkey AS area_id, 4 AS points, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 + 1 AS DOUBLE) AS y
FROM supplier"""

ORACLE = {
    "calls_csv_round_trip": _sql(
        CALLS,
        select="""
SELECT initial_grade_of_response, week, count(*) AS n, CAST(sum(attended_flag) AS BIGINT) AS attended,
       count(call_origin) AS with_origin, count(DISTINCT area_id) AS areas FROM calls GROUP BY ALL""",
    ),
    "stacked_parts": _sql(
        CALLS,
        select="""
SELECT CASE WHEN attended_flag = 1 THEN call_origin END AS call_origin, attended_flag, count(*) AS n
FROM calls WHERE attended_flag IS NOT NULL GROUP BY ALL""",
    ),
    "attribute_sheet": _sql(
        AREAS,
        select="SELECT area_id, imd_rank AS imd_rank_number, CAST(imd_decile AS BIGINT) AS imd_decile FROM areas",
    ),
    "layer_geojson": _SQUARES,
    "layer_kml": _SQUARES,
    "result_store": _sql(
        CALLS,
        select="""
SELECT week, CAST(count(*) AS DOUBLE) AS value, 'calls' AS metric FROM calls GROUP BY week
UNION ALL SELECT week, CAST(count(*) FILTER (WHERE attended_flag = 1) AS DOUBLE), 'attended' FROM calls GROUP BY week""",
    ),
    "layer_store": _SQUARES,
}
