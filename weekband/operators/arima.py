"""Regression with ARMA errors for one weekly series (numpy only)."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEEKS_PER_YEAR = 365.25 / 7.0


def design_matrix(t: np.ndarray, dummies: np.ndarray, pairs: int) -> np.ndarray:
    """Intercept, trend, yearly Fourier pairs, then the dummies."""
    turns = 2 * np.pi * t[:, None] * np.arange(1, pairs + 1) / WEEKS_PER_YEAR
    return np.column_stack([np.ones_like(t), t / WEEKS_PER_YEAR, np.sin(turns), np.cos(turns), dummies])


def independent_columns(x: np.ndarray) -> list[int]:
    """Columns kept when each one that depends on the kept ones before it is dropped."""
    kept: list[int] = []
    basis: list[np.ndarray] = []
    for j in range(x.shape[1]):
        column = x[:, j].astype(float)
        rest = column.copy()
        for _ in range(2):
            for b in basis:
                rest = rest - b * (b @ rest)
        norm = np.linalg.norm(rest)
        if norm > 1e-7 * max(1.0, np.linalg.norm(column)):
            kept.append(j)
            basis.append(rest / norm)
    return kept


def pi_weights(ar: np.ndarray, ma: np.ndarray, length: int) -> np.ndarray:
    """Weights that turn a series into its innovations, up to where they vanish."""
    lead = [1.0, *(-float(c) for c in ar)]
    back = [float(c) for c in ma]
    out: list[float] = []
    for k in range(length):
        value = lead[k] if k < len(lead) else 0.0
        for j, c in enumerate(back[:k], 1):
            value -= c * out[k - j]
        out.append(value)
        if k >= len(lead) and all(abs(v) < 1e-12 for v in out[-max(1, len(back)) :]):
            break
    return np.array(out)


def psi_weights(ar: np.ndarray, ma: np.ndarray, length: int) -> np.ndarray:
    """Weights of past innovations in the series."""
    weights = pi_weights(-ma, -ar, length)
    return np.concatenate([weights, np.zeros(length - len(weights))])


def stable(coefficients: np.ndarray) -> bool:
    """True if 1 - c1 B - c2 B^2 ... has all its roots outside the unit circle, with a margin."""
    c = np.trim_zeros(coefficients, "b")
    if not len(c):
        return True
    return bool(np.abs(np.roots(np.concatenate([[1.0], -c]))).max() < 0.99)


def innovations(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    return np.convolve(x, pi_weights(ar, ma, len(x)))[: len(x)]


def fit_arma(x: np.ndarray, observed: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares over the observed innovations by damped Gauss-Newton steps from zero."""
    params = np.zeros(p + q)

    def errors(v: np.ndarray) -> np.ndarray:
        return innovations(x, v[:p], v[p:])[observed]

    current = errors(params)
    cost, damping = float(current @ current), 1e-3
    for _ in range(40 if p + q else 0):
        jacobian = np.stack(
            [(errors(params + step) - current) / 1e-6 for step in 1e-6 * np.eye(p + q)], axis=1
        )
        normal, gradient = jacobian.T @ jacobian, jacobian.T @ current
        scale = np.diag(np.diag(normal) + 1e-12)
        step = -np.linalg.solve(normal + damping * scale, gradient)
        trial = params + step
        if stable(trial[:p]) and stable(-trial[p:]):
            tried = errors(trial)
            trial_cost = float(tried @ tried)
            if trial_cost < cost:
                small = cost - trial_cost < 1e-9 * cost
                params, current, cost, damping = trial, tried, trial_cost, damping / 5
                if small:
                    break
                continue
        damping *= 10
        if damping > 1e8:
            break
    return params[:p], params[p:], cost


def needs_difference(x: np.ndarray) -> bool:
    """Level-stationarity test (KPSS) at 5 %."""
    n = len(x)
    centred = x - x.mean()
    lags = int(3 * np.sqrt(n) / 13)
    variance = centred @ centred / n
    for k in range(1, lags + 1):
        variance += 2 * (1 - k / (lags + 1)) * (centred[k:] @ centred[:-k]) / n
    if variance <= 0:
        return False
    return float(np.sum(np.cumsum(centred) ** 2) / (n * n * variance)) > 0.463


@dataclass
class Forecast:
    mean: np.ndarray
    sd: np.ndarray
    fitted: np.ndarray


def regression_forecast(
    t: np.ndarray,
    y: np.ndarray,
    dummies: np.ndarray,
    t_new: np.ndarray,
    dummies_new: np.ndarray,
    arma: bool,
    pairs: int = 3,
) -> Forecast | None:
    """Fit on weeks `t` (consecutive; NaN where unknown), forecast weeks `t_new` that follow.

    The forecast starts from the last training week. If the series ended some weeks before `t_new`, those weeks
    are forecast as well and left out, so that the band is as wide as the distance asks for. Without `arma` the
    errors are taken as independent. Returns None if there is too little data. A week that is unknown inside the
    series counts as one on the regression line, an approximation that is good while such weeks are few.
    """
    observed = ~np.isnan(y)
    x_all = design_matrix(t, dummies, pairs)
    kept = independent_columns(x_all[observed]) if observed.any() else []
    n, k = int(observed.sum()), len(kept)
    if n < k + 8:
        return None
    beta = np.linalg.lstsq(x_all[observed][:, kept], y[observed], rcond=None)[0]
    trend_in = x_all[:, kept] @ beta
    trend_out = design_matrix(t_new, dummies_new, pairs)[:, kept] @ beta
    rest = np.where(observed, y - trend_in, 0.0)
    if not arma:
        sd = np.sqrt(rest[observed] @ rest[observed] / (n - k))
        return Forecast(trend_out, np.full(len(t_new), sd), trend_in)

    d = int(needs_difference(rest[observed]))
    series = np.diff(rest) if d else rest
    known = observed[1:] & observed[:-1] if d else observed
    if known.sum() < k + 8:
        d, series, known = 0, rest, observed
    best = None
    for p in range(3):
        for q in range(3):
            ar, ma, cost = fit_arma(series, known, p, q)
            m, free = int(known.sum()), p + q + 1 + k
            if m - free - 1 <= 0:
                continue
            score = m * np.log(max(cost, 1e-300) / m) + 2 * free + 2 * free * (free + 1) / (m - free - 1)
            if best is None or score < best[0]:
                best = (score, ar, ma, cost, m, p + q)
    if best is None:
        return None
    _, ar, ma, cost, m, extra = best
    sigma2 = cost / max(m - k - extra, 1)
    shocks = innovations(series, ar, ma)
    gap = max(int(round(t_new[0] - t[-1])) - 1, 0) if len(t_new) else 0
    horizon = gap + len(t_new)
    ahead = _continue(series, shocks, ar, ma, horizon)
    psi = psi_weights(ar, ma, horizon)
    if d:
        ahead, psi = rest[-1] + np.cumsum(ahead), np.cumsum(psi)
    one_step = series - shocks
    explained = np.concatenate([[0.0], rest[:-1] + one_step]) if d else one_step
    spread = np.sqrt(sigma2 * np.cumsum(psi**2))
    return Forecast(trend_out + ahead[gap:], spread[gap:], trend_in + explained)


def _continue(x: np.ndarray, shocks: np.ndarray, ar: np.ndarray, ma: np.ndarray, horizon: int) -> np.ndarray:
    """Expected next values; future shocks are zero."""
    values, errors = list(x), list(shocks) + [0.0] * horizon
    for h in range(horizon):
        at = len(x) + h
        past = sum(c * values[at - i] for i, c in enumerate(ar, 1) if at >= i)
        past += sum(c * errors[at - i] for i, c in enumerate(ma, 1) if at >= i)
        values.append(past)
    return np.array(values[len(x) :])
