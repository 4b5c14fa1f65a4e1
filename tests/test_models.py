"""Harmonic fit by normal equations and the filter over missing weeks, against numpy."""

import datetime as dt

import numpy as np
import pytest

from weekband.operators import arima
from weekband.operators import forecast as fc
from weekband.operators import kalman
from weekband.operators.series import add_regressors
from weekband.schema import Study, monday

STUDY = Study()
CUT = monday(STUDY.cutoff)


def weeks(n, until=CUT):
    return [until - dt.timedelta(weeks=i) for i in range(n, 0, -1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, week date, y double")


def numpy_band(spark, rows, half):
    """Least squares over independent columns, in another order of time."""
    known = add_regressors(frame(spark, rows), STUDY).orderBy("week").collect()
    ahead = [(w, True, True) for w in STUDY.horizon_weeks()]
    holidays = {r["week"]: r["bank_holiday"] for r in add_regressors(frame(spark, [("a", w, 0.0) for w, _, _ in ahead]), STUDY).collect()}
    first = min(r["week"] for r in known)
    t = lambda w: (w - first).days / 7.0
    seen = [r for r in known if r["y"] is not None]
    dummies = np.array([[r["new_system"], r["hmic_changes"], r["bank_holiday"]] for r in seen], dtype=float)
    x = arima.design_matrix(np.array([t(r["week"]) for r in seen]), dummies, 3)
    y = np.array([r["y"] for r in seen])
    kept = arima.independent_columns(x)
    if len(y) < len(kept) + 8:
        return None
    beta = np.linalg.lstsq(x[:, kept], y, rcond=None)[0]
    sd = np.sqrt(((y - x[:, kept] @ beta) ** 2).sum() / (len(y) - len(kept)))
    later = arima.design_matrix(np.array([t(w) for w, _, _ in ahead]), np.array([[1, 1, holidays[w]] for w, _, _ in ahead], float), 3)
    mean = later[:, kept] @ beta
    return {w: (m, m - half * sd, m + half * sd) for (w, _, _), m in zip(ahead, mean, strict=True)}


@pytest.mark.parametrize("n, missing", [(250, 0), (250, 40), (120, 3), (20, 0), (15, 0)])
def test_harmonic_equals_least_squares(spark, n, missing):
    """120 weeks and fewer have no change of the interventions, so their columns depend on the first one."""
    rng = np.random.default_rng(n + missing)
    y = 200 + np.arange(n) * 0.3 + 20 * np.sin(np.arange(n) / 8.3) + rng.normal(0, 5, n)
    gone = set(rng.choice(n, missing, replace=False).tolist())
    rows = [("a", w, None if i in gone else float(v)) for i, (w, v) in enumerate(zip(weeks(n), y, strict=True))]
    other = [(None, w, float(v) * 2) for w, v in zip(weeks(200), rng.normal(0, 1, 200), strict=True)]
    got = fc.forecast(frame(spark, rows + other), ["k"], "y", STUDY, "harmonic_ols").where("k = 'a'").collect()
    expected = numpy_band(spark, rows, fc.normal_quantile(95.0))
    assert len(got) == 48
    for r in got:
        if expected is None:
            assert r["mean"] is None and r["lower"] is None
        else:
            assert (r["mean"], r["lower"], r["upper"]) == pytest.approx(expected[r["week"]], rel=1e-6, abs=1e-6)


def test_harmonic_has_no_python_in_its_plan(spark):
    series = frame(spark, [("a", w, 1.0) for w in weeks(100)])
    plan = fc.forecast(series, ["k"], "y", STUDY, "harmonic_ols")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def exact(errors, phi):
    """Density of the observed weeks from the covariance of all."""
    at = [i for i, e in enumerate(errors) if e is not None]
    e = np.array([errors[i] for i in at])
    lag = np.abs(np.subtract.outer(at, at))
    cov = phi**lag / (1 - phi * phi)
    return float(e @ np.linalg.solve(cov, e)), float(np.linalg.slogdet(cov)[1]), cov, at, e


@pytest.mark.parametrize("phi", [0.7, -0.5, 0.0])
def test_filter_equals_the_joint_density(spark, phi):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    errors = [float(v) if rng.random() > 0.3 else None for v in rng.normal(0, 2, 40)]
    df = spark.createDataFrame([(errors, phi)], "e array<double>, phi double")
    s = df.select(kalman.filtered(F.col("e"), F.col("phi")).alias("s")).first()["s"]
    squares, logs, cov, at, e = exact(errors, phi)
    assert (s["squares"], s["logs"], s["n"]) == (pytest.approx(squares), pytest.approx(logs, abs=1e-9), len(at))
    # What is known of the last week, from the joint normal law.
    last = np.array([phi ** (len(errors) - 1 - i) for i in at]) / (1 - phi * phi)
    gain = np.linalg.solve(cov, last)
    assert s["mean"] == pytest.approx(float(gain @ e), abs=1e-9)
    assert s["var"] == pytest.approx(1 / (1 - phi * phi) - float(gain @ last), abs=1e-9)


def test_gaps_widen_the_band_and_recover_phi(spark):
    rng = np.random.default_rng(9)
    n, e, y = 400, 0.0, []
    for i in range(n):
        e = 0.8 * e + rng.normal()
        y.append(50 + 0.01 * i + e)
    full = [("full", w, v) for w, v in zip(weeks(n), y, strict=True)]
    gaps = [("gaps", w, v if i < n - 6 else None) for i, (w, v) in enumerate(zip(weeks(n), y, strict=True))]
    few = [("few", w, v if i < 3 else None) for i, (w, v) in enumerate(zip(weeks(n), y, strict=True))]
    series = frame(spark, full + gaps + few)
    band = fc.forecast(series, ["k"], "y", STUDY, "trend_kalman").collect()
    width = lambda k: [r["upper"] - r["lower"] for r in sorted((r for r in band if r["k"] == k), key=lambda r: r["week"])]
    assert width("gaps")[0] > 1.3 * width("full")[0] and width("full")[0] < width("full")[5] < width("full")[40]
    assert all(r["mean"] is None for r in band if r["k"] == "few") and len(band) == 3 * 48
    line = fc.trend_coefficients(series, ["k"], "y", STUDY)
    states = kalman.fitted_states(fc.training(series, STUDY), line, ["k"], "y", fc._line(STUDY)).collect()
    assert all(abs(r["phi"] - 0.8) <= 0.1 for r in states if r["k"] != "few")


def test_orders_equal_yule_walker(spark):
    """The statistic and the errors of all orders against numpy, for a walk, an autoregression, noise and a constant."""
    from weekband.operators import orders

    rng = np.random.default_rng(12)
    noise = rng.normal(0, 1, (3, 160))
    second = np.zeros(160)
    for i in range(2, 160):
        second[i] = 0.5 * second[i - 1] + 0.3 * second[i - 2] + noise[1, i]
    made = {"walk": np.cumsum(noise[0]), "second": second, "noise": noise[2], "flat": np.ones(160), "short": np.arange(7.0)}
    rows = [(k, w, float(v)) for k, x in made.items() for w, v in zip(weeks(len(x)), x, strict=True)]
    rows.append(("noise", weeks(161)[0], None))
    got = {r["k"]: r for r in orders.order_choice(frame(spark, rows), ["k"], "y", 4).collect()}
    assert set(got) == set(made) - {"short"}
    for k, r in got.items():
        x = made[k]
        assert r["n"] == 160 and r["d"] == int(arima.needs_difference(x)) and (r["kpss"] is None) == (k == "flat")
        y = np.diff(x) if r["d"] else x
        y = y - y.mean()
        gamma = np.array([y[lag:] @ y[: len(y) - lag] / len(y) for lag in range(5)])
        scores = []
        for p in range(5):
            toeplitz = gamma[np.abs(np.subtract.outer(range(p), range(p)))] if p else np.zeros((0, 0))
            phi = np.linalg.solve(toeplitz, gamma[1 : p + 1]) if p and k != "flat" else np.zeros(p)
            error = gamma[0] - phi @ gamma[1 : p + 1]
            scores.append(len(y) * np.log(max(error, 1e-300)) + 2 * (p + 1) + 2 * (p + 1) * (p + 2) / (len(y) - p - 2))
        assert r["p"] == int(np.argmin(scores)) and r["criterion"] == pytest.approx(min(scores), abs=1e-6)
    assert got["walk"]["d"] == 1 and got["second"]["p"] >= 1 and got["flat"]["p"] == 0
