import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from weekband.functions import durations, recode as fn
from weekband.operators import recode


def test_type_groups_first_match_and_default(spark):
    df = spark.createDataFrame(
        [("Distraction Burglary",), ("RTC",), ("Training",), ("ASB",), (None,)], "t string"
    )
    got = dict(rows(df.select("t", fn.merge_categories(F.col("t"), fn.TYPE_GROUPS))))
    assert got == {
        "Distraction Burglary": "Burglary - Residential",
        "RTC": "traffic collision",
        "Training": "other - admin",
        "ASB": "ASB",
        None: None,
    }


def test_origin_groups(spark):
    df = spark.createDataFrame(
        [("Helpdesk",), ("ANPR",), ("Unknown Choice List Value",), (None,),
         ("Police Generated (inc. Call Sign / Collar Numbers)",)], "o string",
    )
    got = dict(rows(df.select("o", fn.merge_origins(F.col("o")))))
    assert got["Helpdesk"] == "public non-emergency"
    assert got["ANPR"] == "ANPR"
    assert got["Unknown Choice List Value"] is None and got[None] is None
    assert got["Police Generated (inc. Call Sign / Collar Numbers)"] == "police generated"


def rare_input(spark):
    sizes = {"a": 999, "b": 1000, "RTC": 3}
    data = [(t,) for t, n in sizes.items() for _ in range(n)] + [(None,)] * 5
    return spark.createDataFrame(data, "incident_type string")


def test_rare_fold_is_strict_counts_null_and_keeps_rows(spark):
    calls = rare_input(spark)
    out = recode.recode_types(calls)
    got = {(r[0], r[1]): r[2] for r in out.groupBy("incident_type", "incident_type_new").count().collect()}
    assert got == {
        ("a", "other - minor"): 999,
        ("b", "b"): 1000,
        ("RTC", "traffic collision"): 3,
        (None, "other - minor"): 5,
    }


def test_folding_after_counting_agrees(spark):
    calls = rare_input(spark).withColumn("week", (F.monotonically_increasing_id() % 7))
    counted = calls.groupBy("incident_type", "week").agg(F.count("*").alias("n"))
    early = recode.recode_types(calls).groupBy("incident_type_new", "week").agg(F.count("*").alias("n"))
    late = recode.recode_counted_types(counted).groupBy("incident_type_new", "week").agg(F.sum("n").alias("n"))
    assert rows(early, "incident_type_new", "week", "n") == rows(late, "incident_type_new", "week", "n")


def test_common_null_stays_null(spark):
    calls = spark.createDataFrame([(None,)] * 3 + [("x",)] * 3, "incident_type string")
    out = recode.recode_types(calls, threshold=3)
    assert rows(out.select("incident_type_new").distinct()) == [(None,), ("x",)]


def test_half_day_repair_and_clamp(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -10.0), (3, -721.0), (4, None)], "i int, x double")
    got = dict(rows(df.select("i", durations.repair_half_day(F.col("x")))))
    assert got == {1: 5.0, 2: 710.0, 3: -1.0, 4: None}
    got = dict(rows(df.select("i", durations.clamp_at_zero(F.col("x")))))
    assert got == {1: 5.0, 2: 0.0, 3: 0.0, 4: None}
    got = dict(rows(df.select("i", durations.sign_class(F.col("x")))))
    assert got == {1: "non-negative", 2: "negative", 3: "negative", 4: None}


def test_minutes_ignore_the_session_time_zone(spark):
    """London lost an hour on 29 March 2020; plain timestamps must not."""
    df = spark.createDataFrame(
        [(dt.datetime(2020, 3, 29, 0, 30), dt.datetime(2020, 3, 29, 2, 0, 30, 500000))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/London"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(durations.minutes_between(F.col("a"), F.col("b"))).first()[0]
            assert abs(got - (90 + 30.5 / 60)) < 1e-9
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_round_half_even(spark):
    df = spark.createDataFrame([(12.25,), (12.35,), (0.5,)], "x double")
    assert [r[0] for r in df.select(durations.round_half_even(F.col("x"), 1)).collect()] == [12.2, 12.4, 0.5]


def test_yes_no(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (7,)], "f int")
    assert [r[0] for r in df.select(fn.yes_no(F.col("f"))).collect()] == ["Yes", "No", None, None]
