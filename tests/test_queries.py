"""Every named query against its SQL twin, and values known in advance."""

import datetime as dt

import duckdb
import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weekband.operators import quantiles
from weekband.plans import queries as q
from weekband.plans import roundtrips
from weekband.plans.oracle import ORACLE as TWINS
from weekband.plans.products import Names, all_products

QUERIES, ORACLE = {**q.QUERIES, **roundtrips.QUERIES}, {**TWINS, **roundtrips.ORACLE}
WITHOUT_TWIN = {
    "forecast_arima_band",
    "arima_fitted",
    "forecast_products_arima",
}
SMALL, MEDIUM = str(TESTDATA / "sf0.001"), str(TESTDATA / "sf0.01")

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in (TESTDATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def comparable(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return "NULL" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


def test_only_known_queries_lack_a_twin():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_TWIN
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    cursor = duck.execute(ORACLE[name])
    expected = comparable([c[0] for c in cursor.description], cursor.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry_flags_weeks(spark):
    band = entry.entry(spark)
    assert band.columns == ["incident_type_new", "week", "actual", "mean", "lower", "upper", "sig"]
    assert band.count() > 0


def test_shift_bands_of_events(spark):
    got = q.shift_band_counts(spark, MEDIUM).groupBy("shift").agg(F.sum("n"))
    assert dict(rows(got)) == {"Early": 2517, "Daytime": 2544, "Evening": 2490, "Late": 2449}


def test_first_gini(spark):
    got = rows(q.gini_weekly(spark, MEDIUM), "week", "gini")
    assert len(got) == 345 and got[0] == (dt.date(1994, 12, 26), 0.95)


def test_tercile_sizes(spark):
    got = q.dep_terciles(spark, MEDIUM).where("imd_rank IS NOT NULL").groupBy("dep_level").count()
    assert dict(rows(got)) == {"high": 31, "medium": 32, "low": 31}


def test_moran_of_call_counts(spark):
    assert q.moran_global(spark, MEDIUM).first()["moran_i"] == -0.031969


def test_median_raw_response(spark):
    timed = q.with_response(q.star.calls(spark, MEDIUM, [*q.RESPONSE, q.GRADE]))
    got = dict(rows(quantiles.median(timed, [q.GRADE], "raw_minutes", 60.0), q.GRADE, "median"))
    assert [got[f"Grade {g}"] for g in range(1, 6)] == [55440, 64800, -34560, -10080, 125280]


def test_arima_band_has_48_weeks_per_key(spark):
    band = q.forecast_arima_band(spark, SMALL).cache()
    ahead = band.where("mean IS NOT NULL")
    per_key = [r["count"] for r in ahead.groupBy("incident_type_new").count().collect()]
    assert per_key and set(per_key) == {48}
    assert ahead.where("NOT (lower <= mean AND mean <= upper)").count() == 0


def test_p_values_agree_with_critical_z(spark):
    by_p = dict(rows(q.moran_p_values(spark, MEDIUM), "area_id", "quadrant"))
    by_z = dict(rows(q.moran_quadrants(spark, MEDIUM), "area_id", "quadrant"))
    assert by_p == by_z


def test_products_cover_all_twenty():
    products = all_products(Names())
    assert len({p.metric for p in products}) == 20
    assert sum(p.measure == "gini" for p in products) == 6
    assert {p.key for p in products} == {None, "incident_type_new", q.GRADE, "call_origin", "dep_level"}


def test_all_products_with_arima(spark):
    band = q.forecast_products_arima(spark, MEDIUM).where("mean IS NOT NULL")
    per_series = band.groupBy("metric", "key_value").count()
    assert per_series.select("metric").distinct().count() == 20
    assert rows(per_series.select("count").distinct()) == [(48,)]
