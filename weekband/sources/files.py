"""Readers and writers for calls, layers and result tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekband.schema import CALLS


def clean_name(name: str) -> str:
    """snake_case: words split at case changes and at anything that is not a letter or digit."""
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", " percent ").replace("#", " number "))
    cleaned = re.sub(r"[^0-9A-Za-z]+", "_", words).strip("_").lower() or "x"
    return f"x{cleaned}" if cleaned[0].isdigit() else cleaned


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to snake_case; a repeated name gets a running number."""
    names: list[str] = []
    for column in df.columns:
        base, name, k = clean_name(column), clean_name(column), 2
        while name in names:
            name, k = f"{base}_{k}", k + 1
        names.append(name)
    return df.toDF(*names)


def read_calls(spark: SparkSession, path: str, schema: T.StructType = CALLS) -> DataFrame:
    """Calls from CSV, plain or gzip, with a header row; an empty field is NULL.

    A gzip file cannot be split: store many parts, or convert to Parquet once.
    """
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_named_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose headings are normalised and whose types are inferred (small attribute sheets)."""
    return clean_names(spark.read.csv(path, header=True, inferSchema=True))


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


_POSITION = T.ArrayType(T.DoubleType())


def _to_points(ring):
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_geojson(
    spark: SparkSession, path: str, properties: T.StructType, lines: bool = False
) -> DataFrame:
    """One row per feature: the listed properties and `rings`.

    Polygons and multi-polygons both become a flat list of rings. `lines` reads one feature per
    line, which Spark can split; a feature collection is one JSON document per file.
    """
    geometry = T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
    )
    feature = T.StructType(
        [T.StructField("properties", properties), T.StructField("geometry", geometry)]
    )
    if lines:
        features = spark.read.schema(feature).json(path)
    else:
        collection = T.StructType([T.StructField("features", T.ArrayType(feature))])
        features = (
            spark.read.schema(collection)
            .json(path, multiLine=True)
            .select(F.explode("features").alias("f"))
            .select("f.properties", "f.geometry")
        )
    text = F.col("geometry.coordinates")
    polygon = F.from_json(text, T.ArrayType(T.ArrayType(_POSITION)))
    multi = F.flatten(F.from_json(text, T.ArrayType(T.ArrayType(T.ArrayType(_POSITION)))))
    rings = F.when(F.col("geometry.type") == "MultiPolygon", multi).otherwise(polygon)
    return features.select("properties.*", F.transform(rings, _to_points).alias("rings"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """One row per placemark with `rings`, whether its polygons are single or grouped."""
    ring = T.StructType(
        [T.StructField("LinearRing", T.StructType([T.StructField("coordinates", T.StringType())]))]
    )
    polygon = T.StructType(
        [
            T.StructField("outerBoundaryIs", ring),
            T.StructField("innerBoundaryIs", T.ArrayType(ring)),
        ]
    )
    schema = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("Polygon", polygon),
            T.StructField(
                "MultiGeometry", T.StructType([T.StructField("Polygon", T.ArrayType(polygon))])
            ),
        ]
    )
    placemarks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    polygons = F.coalesce(F.col("MultiGeometry.Polygon"), F.array("Polygon"))
    texts = F.flatten(
        F.transform(
            polygons,
            lambda p: F.concat(
                F.array(p.outerBoundaryIs.LinearRing.coordinates),
                F.coalesce(
                    F.transform(p.innerBoundaryIs, lambda r: r.LinearRing.coordinates),
                    F.array().cast("array<string>"),
                ),
            ),
        )
    )
    return placemarks.select("name", F.transform(texts, _parse_coordinates).alias("rings"))


def _parse_coordinates(text):
    def point(triple):
        part = F.split(triple, ",")
        return F.struct(part[0].cast("double").alias("x"), part[1].cast("double").alias("y"))

    return F.transform(F.split(F.trim(text), r"\s+"), point)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_results(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("metric",)
) -> None:
    """Result store: one Parquet table; only the partitions present in `df` are replaced."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str, metric: str | None = None) -> DataFrame:
    """Stored results, one metric (a partition) or all."""
    results = spark.read.parquet(path)
    return results if metric is None else results.where(F.col("metric") == metric)


def write_layer(df: DataFrame, path: str) -> None:
    """Area layer with its nested rings."""
    df.write.mode("overwrite").parquet(path)
