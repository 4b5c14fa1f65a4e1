import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekband.operators import areas as area_ops
from weekband.operators import geometry, moran
from weekband.operators.concentration import gini, ties
from weekband.operators.shares import area_adjusted_share


def square(x, y, size=1.0):
    return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size)]]


LAYER = "area_id long, rings array<array<struct<x: double, y: double>>>"


def layer(spark, shapes):
    data = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in shapes.items()]
    return spark.createDataFrame(data, LAYER)


def grid3(spark):
    return layer(spark, {3 * r + c: square(float(c), float(r)) for r in range(3) for c in range(3)})


@pytest.mark.parametrize(
    ("values", "areas", "expected"),
    [((0, 0, 1, 5), 4, 0.6667), ((1, 1, 1), 3, 0.0), ((2, 2, 4, 0, 0, 9), 6, None)],
)
def test_gini(spark, values, areas, expected):
    df = spark.createDataFrame([("w", i, v) for i, v in enumerate(values)], "week string, area long, n long")
    got = gini(ties(df, ["week"]), ["week"], F.lit(areas)).first()["gini"]
    x, n = np.sort(values), len(values)
    brute = 2 * np.sum(np.arange(1, n + 1) * x) / (n * x.sum()) - (n + 1) / n
    assert got == pytest.approx(brute)
    if expected is not None:
        assert got == pytest.approx(expected, abs=1e-4)


def test_gini_of_absent_areas_equals_gini_of_zeros(spark):
    df = spark.createDataFrame([("w", 1, 1), ("w", 2, 5)], "week string, area long, n long")
    assert gini(ties(df, ["week"]), ["week"], F.lit(4)).first()["gini"] == pytest.approx(2 / 3)


def test_gini_without_calls_has_no_row(spark):
    df = spark.createDataFrame([("w", 1, 0)], "week string, area long, n long")
    assert gini(ties(df, ["week"]), ["week"], F.lit(4)).count() == 0


def test_tercile_sizes_follow_residue_classes(spark):
    ranks = [r for r in range(1, 101) if r % 17]
    df = spark.createDataFrame([(r, r if r % 5 else None) for r in ranks], "area_id long, imd_rank long")
    kept = sorted(r for r in ranks if r % 5)
    sizes = [sum(r % 3 == k for r in kept) for k in range(3)]
    expected = {r: "high" if i < sizes[0] else "medium" if i < sizes[0] + sizes[1] else "low" for i, r in enumerate(kept)}
    got = dict(rows(area_ops.deprivation_terciles(df), "area_id", "dep_level"))
    assert {k: v for k, v in got.items() if v is not None} == expected
    assert sum(v is None for v in got.values()) == len(ranks) - len(kept)


def test_panel_has_every_area_and_week(spark):
    import datetime as dt

    w = [dt.date(2020, 1, 6) + dt.timedelta(weeks=i) for i in range(3)]
    areas = spark.createDataFrame([(1, 9), (2, None)], "area_id long, imd_decile int")
    counts = spark.createDataFrame([(1, w[1], 4), (7, w[0], 3)], "area_id long, week date, n long")
    panel = area_ops.area_week_panel(counts, areas, (F.lit(w[0]), F.lit(w[2])))
    assert rows(panel, "area_id", "imd_decile", "week", "n") == [
        (1, 9, w[0], 0), (1, 9, w[1], 4), (1, 9, w[2], 0),
        (2, None, w[0], 0), (2, None, w[1], 0), (2, None, w[2], 0),
    ]


def test_decile_share_is_per_area(spark):
    import datetime as dt

    w = [dt.date(2020, 1, 6) + dt.timedelta(weeks=i) for i in range(3)]
    areas = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "area_id long, imd_decile int")
    counts = spark.createDataFrame(
        [(1, w[0], 9), (1, w[1], 2), (2, w[1], 2), (3, w[1], 4), (3, w[2], 1)], "area_id long, week date, n long"
    )
    got = rows(area_adjusted_share(counts, areas), "imd_decile", "week", "calls_per_area", "share")
    assert got == [(1, w[1], 2.0, pytest.approx(1 / 3)), (2, w[1], 4.0, pytest.approx(2 / 3))]


def test_before_after_splits_at_the_week(spark):
    import datetime as dt

    areas = spark.createDataFrame([(1,), (2,)], "area_id long")
    counts = spark.createDataFrame(
        [(1, dt.date(2020, 1, 20), 2), (1, dt.date(2020, 1, 27), 5)], "area_id long, week date, n long"
    )
    got = rows(area_ops.before_after(counts, areas, dt.date(2020, 1, 31)), "area_id", "pre", "post")
    assert got == [(1, 2, 5), (2, 0, 0)]


def test_corner_contact_is_queen_contiguity(spark):
    shapes = {1: square(0, 0), 2: square(1, 1), 3: square(5, 5)}
    assert rows(geometry.queen_neighbours(layer(spark, shapes))) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("noise", [0.0, 0.9e-8, -0.9e-8])
def test_contiguity_survives_vertex_noise(spark, noise):
    shapes = {1: square(0, 0), 2: square(1 + noise, 0), 3: square(2.1, 0)}
    assert rows(geometry.queen_neighbours(layer(spark, shapes))) == [(1, 2), (2, 1)]


def test_contiguity_across_any_cell_border(spark):
    rng = np.random.default_rng(3)
    spots = rng.uniform(-50, 50, size=(60, 2))
    shift = rng.uniform(-1, 1, size=(60, 2)) * 1.0e-8
    shapes = {}
    for i, ((x, y), (dx, dy)) in enumerate(zip(spots, shift)):
        shapes[2 * i] = [[(x, y), (x + 0.01, y), (x, y + 0.01)]]
        shapes[2 * i + 1] = [[(x + dx, y + dy), (x - 0.02, y), (x, y - 0.02)]]
    got = rows(geometry.queen_neighbours(layer(spark, shapes)))
    assert got == sorted((a, b) for i in range(60) for a, b in ((2 * i, 2 * i + 1), (2 * i + 1, 2 * i)))


def test_exact_contiguity_without_snap(spark):
    shapes = {1: square(0, 0), 2: square(1, 0), 3: square(1 + 1e-9, 1)}
    assert rows(geometry.queen_neighbours(layer(spark, shapes), snap=0.0)) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("cell", [0.4, 3.0, 100.0])
def test_spatial_join_cases(spark, cell):
    ring = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]
    boundary = spark.createDataFrame(
        [(1, [[(float(x), float(y)) for x, y in r] for r in ring])],
        LAYER.replace("area_id", "boundary_id"),
    )
    shapes = {
        1: square(1, 1),            # inside
        2: square(9.5, 9.5),        # crosses
        3: square(10, 3),           # shares an edge
        4: square(-1, -1),          # shares a corner
        5: square(12, 12),          # apart
        6: square(4.5, 4.5, 0.5),   # inside the hole
        7: square(-5, -5, 30),      # contains everything
        8: square(10.0000001, 5),   # just apart
    }
    got = geometry.areas_meeting(layer(spark, shapes), boundary, "area_id", "boundary_id", cell)
    assert [r[0] for r in rows(got, "area_id")] == [1, 2, 3, 4, 7]


def test_pairs_appear_once_in_many_cells(spark):
    left = layer(spark, {1: square(0, 0, 5), 2: square(20, 20)})
    right = layer(spark, {7: square(1, 1, 5)}).withColumnRenamed("area_id", "other")
    assert rows(geometry.candidate_pairs(left, right, "area_id", "other", 0.5)) == [(1, 7)]


def brute_moran(values, edges):
    n = len(values)
    w = np.zeros((n, n))
    for a, b in edges:
        w[a, b] = 1
    w /= w.sum(axis=1, keepdims=True)
    z = values - values.mean()
    return w, z, z @ w @ z / (z @ z)


def moran_inputs(spark):
    values = np.arange(9.0) // 3
    values[4] = 5.0
    edges = geometry.queen_neighbours(grid3(spark))
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "area_id long, x double")
    lagged = moran.spatial_lag(table, moran.row_weights(edges), "x").cache()
    return values, [tuple(r) for r in edges.collect()], lagged


def test_moran_against_matrices(spark):
    values, edges, lagged = moran_inputs(spark)
    w, z, expected = brute_moran(values, edges)
    row = moran.moran_global(lagged, "x").first()
    assert row["n"] == 9 and row["moran_i"] == pytest.approx(expected)
    assert row["kurtosis"] == pytest.approx(9 * np.sum(z**4) / np.sum(z**2) ** 2)
    m2 = np.mean(z**2)
    local = {r["area_id"]: r for r in moran.moran_local(lagged, "x").collect()}
    for i in range(9):
        assert local[i]["local_i"] == pytest.approx(z[i] / m2 * (w @ z)[i])


def test_local_moran_moments_by_permutation(spark):
    """Conditional moments: shuffle the other areas' values around one area many times."""
    values, edges, lagged = moran_inputs(spark)
    w, z, _ = brute_moran(values, edges)
    local = {r["area_id"]: r for r in moran.moran_local(lagged, "x").collect()}
    rng = np.random.default_rng(1)
    i, m2 = 4, np.mean(z**2)
    others = np.delete(np.arange(9), i)
    draws = []
    for _ in range(20000):
        shuffled = z.copy()
        shuffled[others] = rng.permutation(z[others])
        draws.append(z[i] / m2 * (w[i] @ shuffled))
    assert local[i]["expectation"] == pytest.approx(np.mean(draws), abs=0.02)
    i = 0
    others = np.delete(np.arange(9), i)
    draws = []
    for _ in range(40000):
        shuffled = z.copy()
        shuffled[others] = rng.permutation(z[others])
        draws.append(z[i] / m2 * (w[i] @ shuffled))
    assert local[i]["expectation"] == pytest.approx(np.mean(draws), abs=0.01)
    assert local[i]["variance"] == pytest.approx(np.var(draws), rel=0.05)


def test_local_moran_total_moments_by_permutation(spark):
    values, edges, lagged = moran_inputs(spark)
    w, z, _ = brute_moran(values, edges)
    local = {r["area_id"]: r for r in moran.moran_local(lagged, "x", conditional=False).collect()}
    rng = np.random.default_rng(2)
    m2 = np.mean(z**2)
    draws = np.array([p * (w @ p) / m2 for p in (rng.permutation(z) for _ in range(30000))])
    for i in (0, 1, 4):
        assert local[i]["expectation"] == pytest.approx(draws[:, i].mean(), abs=0.02)
        assert local[i]["variance"] == pytest.approx(draws[:, i].var(), rel=0.05)


def test_isolates_are_reported_and_left_out(spark):
    areas = layer(spark, {1: square(0, 0), 2: square(1, 0), 3: square(9, 9)})
    edges = geometry.queen_neighbours(areas)
    assert [r["area_id"] for r in moran.isolates(areas, edges).collect()] == [3]
    values = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 8.0)], "area_id long, x double")
    lagged = moran.spatial_lag(values, moran.row_weights(edges), "x")
    assert rows(lagged, "area_id", "lag") == [(1, 3.0), (2, 1.0)]


def test_quadrant_names_and_p_values(spark):
    df = spark.createDataFrame(
        [("hh", 1.0, 1.0, 3.0), ("hl", 1.0, -1.0, -3.0), ("lh", -1.0, 1.0, -3.0), ("ll", -1.0, -1.0, 3.0),
         ("ns", 1.0, 1.0, 1.0), ("flat", 0.0, 1.0, None)],
        "name string, z double, lag_z double, z_score double",
    )
    got = dict(rows(moran.quadrants(df), "name", "quadrant"))
    assert got == {
        "hh": "high-high", "hl": "high-low", "lh": "low-high", "ll": "low-low",
        "ns": "non-significant", "flat": "non-significant",
    }
    p = dict(rows(moran.with_p_value(df), "name", "p_value"))
    assert p["hh"] == pytest.approx(math.erfc(3 / math.sqrt(2))) and p["flat"] is None
    one_sided = dict(rows(moran.with_p_value(df, "greater"), "name", "p_value"))
    assert one_sided["hl"] == pytest.approx(1 - 0.5 * math.erfc(3 / math.sqrt(2)))


def test_standardize_uses_sample_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")
    got = [r[0] for r in rows(moran.standardize(df, "x", "z"), "z")]
    x = np.array([1.0, 2.0, 6.0])
    assert got == pytest.approx(list((x - 3) / x.std(ddof=1)))
