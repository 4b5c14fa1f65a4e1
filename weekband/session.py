"""Session settings and the one place where an intermediate table is made durable."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "weekband", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application for intermediate tables, which all executors share.

    It lies in `spark.checkpoint.dir`; where that is unset, in the warehouse folder, which a cluster
    shares as well. It is deleted when the application ends.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    folder = f"{root.rstrip('/')}/weekband-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it from there.

    Used where one aggregated table feeds several branches of a plan, so that the events are
    scanned once and lost executors cost no recomputation. The written table also has a known
    size, by which later joins are planned.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
