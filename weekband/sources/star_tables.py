"""Adapters from a star schema of orders to the canonical `calls` and `areas` tables.

A line item plays the part of a call, its order gives time, grade and attendance, its part the
type, its customer the origin, and its supplier the area. Only the joins that the asked columns
need are made; none of them loses a call, so the rows do not depend on the columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekband.operators.quantiles import global_position, tile
from weekband.schema import Study

STUDY = Study().shifted(-20)
GRID_WIDTH = 10

_FROM_PART = {"incident_type": "p_brand"}
_FROM_CUSTOMER = {"call_origin": "CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END"}
_FROM_LINE = {
    "incident_date_time": "o_orderdate",
    "earliest_deployed_date_time": "o_orderdate",
    "initial_grade_of_response": "concat('Grade ', substr(o_orderpriority, 1, 1))",
    "attended_flag": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END",
    "earliest_arrived_date_time": "l_shipdate",
    "released_date_time": "l_shipdate + make_dt_interval(0, 0, CAST(l_quantity AS INT) - 5, 0)",
    "area_id": "l_suppkey",
}
_COLUMNS = {**_FROM_LINE, **_FROM_PART, **_FROM_CUSTOMER}


# Columns in use; a fixed schema spares the read of a file footer before planning.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double,"
    " l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_brand string",
    "customer": "c_custkey bigint, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_acctbal double",
    "events": "ts timestamp_ntz, event_type string, value double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def calls(spark: SparkSession, folder: str, columns: Iterable[str]) -> DataFrame:
    """Calls with the asked columns; `incident_date_time` is always there."""
    wanted = list(dict.fromkeys(["incident_date_time", *columns]))
    rows = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    if set(wanted) & set(_FROM_PART):
        rows = rows.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if set(wanted) & set(_FROM_CUSTOMER):
        rows = rows.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(*(F.expr(_COLUMNS[c]).alias(c) for c in wanted))


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """Areas with deprivation rank and decile, NULL for every seventeenth one."""
    suppliers = table(spark, folder, "supplier")
    total = suppliers.agg(F.count(F.lit(1))).scalar()
    balance, block = F.col("s_acctbal"), F.floor(F.col("s_suppkey") / 65536)
    placed = global_position(
        suppliers,
        ["s_acctbal", "s_suppkey"],
        [F.floor(balance), F.struct(balance, block.alias("block"))],
        "position",
    )
    ranked = F.col("s_suppkey") % 17 != 0
    return placed.select(
        F.col("s_suppkey").alias("area_id"),
        F.when(ranked, F.col("position")).alias("imd_rank"),
        F.when(ranked, tile(F.col("position"), total, 10)).cast("int").alias("imd_decile"),
    )


def deprivation_sheet(areas: DataFrame) -> DataFrame:
    """Attribute table that lacks the areas without a rank."""
    return areas.where(F.col("imd_rank").isNotNull())


def layer(spark: SparkSession, folder: str) -> DataFrame:
    """Area polygons: unit squares on a grid ten wide."""
    gx = (F.col("s_suppkey") % GRID_WIDTH).cast("double")
    gy = F.floor(F.col("s_suppkey") / GRID_WIDTH).cast("double")

    def corner(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(corner(gx, gy), corner(gx + 1, gy), corner(gx + 1, gy + 1), corner(gx, gy + 1))
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("area_id"), F.array(ring).alias("rings")
    )


def boundary(spark: SparkSession) -> DataFrame:
    """One rectangle that cuts through the grid."""
    corners = [(2.5, 1.5), (6.5, 1.5), (6.5, 5.5), (2.5, 5.5)]
    points = F.array(
        *(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners)
    )
    return spark.range(1).select(F.lit(1).alias("boundary_id"), F.array(points).alias("rings"))


def timed_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with a time of day, from the event stream."""
    return table(spark, folder, "events").select(
        F.col("ts").alias("incident_date_time"),
        F.col("event_type").alias("incident_type"),
        F.col("value").alias("minutes"),
    )
