import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from weekband.operators import quantiles as q


def test_median_of_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert q.median(df, [], "x", 1.0).first()["median"] == 2.5


@pytest.mark.parametrize("width", [0.01, 1.0, 1e6])
def test_quantiles_match_brute_force(spark, width):
    rng = np.random.default_rng(7)
    # One key holds more than a third of the rows; values repeat, are negative, and may be NULL.
    keys = rng.choice(["hot", "b", "c", None], p=[0.5, 0.3, 0.1, 0.1], size=4000)
    values = np.round(rng.normal(scale=50, size=4000), 1)
    pdf = pd.DataFrame({"k": keys, "x": values})
    pdf.loc[rng.random(4000) < 0.1, "x"] = None
    df = spark.createDataFrame(list(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)), "k string, x double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    got = {r["k"]: r for r in q.quantiles(df, ["k"], "x", probs, width).collect()}
    assert set(got) == {"hot", "b", "c", None}
    for key, row in got.items():
        x = pdf.loc[pdf["k"].isna() if key is None else pdf["k"] == key, "x"].dropna()
        assert row["n"] == len(x)
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(x.to_numpy(dtype=float), p), abs=1e-9)


def test_group_of_nulls_keeps_its_row(spark):
    df = spark.createDataFrame([("a", None), ("b", 4.0)], "k string, x double")
    assert rows(q.median(df, ["k"], "x", 1.0)) == [("a", 0, None), ("b", 1, 4.0)]


def test_weights_count_as_repeats(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 4)], "x double, m int")
    assert q.median(df, [], "x", 1.0, weight="m").first()["median"] == 5.0


def test_global_position_and_tile_match_windows(spark):
    # A third of the rows share one value.
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.hash("id") % 1000 / 7.0)
    df = spark.range(1, 95).select("id", value.alias("v"))
    buckets = [F.floor("v"), F.col("v"), F.floor(F.col("id") / 8)]
    placed = q.global_position(df, ["v", "id"], buckets, "position")
    assert rows(q.global_position(df, ["v", "id"], buckets[:1], "position")) == rows(placed)
    everything = Window.orderBy("v", "id")
    both = placed.select(
        "position",
        F.row_number().over(everything).alias("r"),
        q.tile(F.col("position"), F.lit(94), 10).alias("t"),
        F.ntile(10).over(everything).alias("nt"),
    )
    assert both.where("position <> r OR t <> nt").count() == 0
    assert both.count() == 94


def test_tile_with_fewer_rows_than_tiles(spark):
    df = spark.range(1, 4).select(q.tile(F.col("id"), F.lit(3), 10).alias("t"))
    assert rows(df) == [(1,), (2,), (3,)]


def test_one_scan_feeds_both_steps(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("x"))
    out = q.median(df, ["k"], "x", 10.0)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
