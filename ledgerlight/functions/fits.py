"""Fits of one short series, called inside tasks that each hold many series."""

from __future__ import annotations

import datetime as dt
import itertools
from statistics import NormalDist

import numpy as np

SEASON = 12
CANDIDATE_ORDERS = tuple(o for o in itertools.product(range(3), range(2), range(3)) if o != (0, 0, 0))
DEFAULT_ORDER = (1, 1, 1)
CHANGEPOINTS = 25
CHANGEPOINT_SHARE = 0.8
CHANGEPOINT_SCALE = 0.05
FOURIER_ORDER = 10
YEAR_DAYS = 365.25


def _lagged(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    return np.column_stack([x[start - i - 1:len(x) - i - 1] for i in range(lags)]) if lags else np.empty((len(x) - start, 0))


def fit_arima(y: np.ndarray, order: tuple[int, int, int]) -> dict | None:
    """Two-stage least squares: residuals of a long autoregression stand in for the shocks.

    Returns coefficients, residuals, variance, AIC and BIC; None when the series is too short
    or the fit is not stationary and invertible.
    """
    p, d, q = order
    w = np.diff(np.asarray(y, dtype=float), n=d) if d else np.asarray(y, dtype=float)
    mean = 0.0 if d else w.mean()
    w = w - mean
    n, lags = len(w), max(p, q)
    if n < 2 * (p + q) + 3:
        return None
    shocks = np.zeros(n)
    if q:
        long = min(max(lags + 1, int(10 * np.log10(n))), n // 3)
        if long < 1:
            return None
        coef = np.linalg.lstsq(_lagged(w, long, long), w[long:], rcond=None)[0]
        shocks[long:] = w[long:] - _lagged(w, long, long) @ coef
        start = min(long + q, n - (p + q) - 2)
    else:
        start = p
    start = max(start, lags)
    design = np.hstack([_lagged(w, p, start), _lagged(shocks, q, start)])
    coef = np.linalg.lstsq(design, w[start:], rcond=None)[0] if p + q else np.empty(0)
    phi, theta = coef[:p], coef[p:]
    for poly in (np.r_[1.0, -phi], np.r_[1.0, theta]):
        if len(poly) > 1 and np.any(np.abs(np.roots(poly)) >= 0.999):
            return None
    errors = np.zeros(n)
    for t in range(n):
        past = sum(phi[i] * w[t - i - 1] for i in range(min(p, t))) + sum(theta[j] * errors[t - j - 1] for j in range(min(q, t)))
        errors[t] = w[t] - past
    variance = max(float(errors @ errors) / n, 1e-12)
    loss, size = n * (np.log(2 * np.pi * variance) + 1), p + q + 1 + (0 if d else 1)
    return {"order": order, "phi": phi, "theta": theta, "mean": mean, "w": w, "errors": errors, "variance": variance,
            "aic": float(loss + 2 * size), "bic": float(loss + size * np.log(n))}


def predict_arima(y: np.ndarray, fit: dict, periods: int, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecasts with lower and upper bound."""
    (p, d, q), phi, theta = fit["order"], fit["phi"], fit["theta"]
    w, errors = list(fit["w"]), list(fit["errors"])
    for _ in range(periods):
        ar = sum(phi[i] * w[-i - 1] for i in range(min(p, len(w))))
        ma = sum(theta[j] * errors[-j - 1] for j in range(min(q, len(errors))))
        w.append(ar + ma)
        errors.append(0.0)
    ahead = np.array(w[-periods:]) + fit["mean"]
    weights = np.zeros(periods)
    weights[0] = 1.0
    for i in range(1, periods):
        weights[i] = (theta[i - 1] if i <= q else 0.0) + sum(phi[j] * weights[i - j - 1] for j in range(min(p, i)))
    if d:
        ahead = y[-1] + np.cumsum(ahead)
        weights = np.cumsum(weights)
    half = NormalDist().inv_cdf(0.5 + confidence / 2) * np.sqrt(fit["variance"] * np.cumsum(weights ** 2))
    return ahead, ahead - half, ahead + half


def us_holidays(year: int) -> dict[str, dt.date]:
    """Federal holidays of a year, by rule."""
    def nth(month: int, weekday: int, n: int) -> dt.date:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))

    last_may = dt.date(year, 5, 31)
    return {
        "new_year": dt.date(year, 1, 1), "king": nth(1, 0, 3), "presidents": nth(2, 0, 3),
        "memorial": last_may - dt.timedelta(days=last_may.weekday()), "juneteenth": dt.date(year, 6, 19),
        "independence": dt.date(year, 7, 4), "labor": nth(9, 0, 1), "columbus": nth(10, 0, 2),
        "veterans": dt.date(year, 11, 11), "thanksgiving": nth(11, 3, 4), "christmas": dt.date(year, 12, 25),
    }


def _additive_design(days: np.ndarray, dates: list[dt.date], knots: np.ndarray, low: float, span: float, holidays: bool) -> np.ndarray:
    t = (days - low) / span
    angle = 2 * np.pi * np.outer(days, np.arange(1, FOURIER_ORDER + 1)) / YEAR_DAYS
    parts = [np.ones((len(t), 1)), t[:, None], np.maximum(t[:, None] - knots, 0.0), np.sin(angle), np.cos(angle)]
    if holidays:
        by_year = {y: us_holidays(y) for y in {d.year for d in dates}}
        names = list(us_holidays(2000))
        parts.append(np.array([[float(by_year[d.year][name] == d) for name in names] for d in dates]))
    return np.hstack(parts)


def fit_additive(dates: list[dt.date], y: np.ndarray, future: list[dt.date], confidence: float = 0.95,
                 holidays: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piecewise linear trend, yearly season and holidays as one penalised regression."""
    y = np.asarray(y, dtype=float)
    scale = float(np.abs(y).max()) or 1.0
    days = np.array([d.toordinal() for d in dates], dtype=float)
    low, span = days[0], max(days[-1] - days[0], 1.0)
    count = max(0, min(CHANGEPOINTS, int(CHANGEPOINT_SHARE * len(y)) - 1))
    knots = np.linspace(0, CHANGEPOINT_SHARE, count + 2)[1:-1] if count else np.empty(0)
    x = _additive_design(days, dates, knots, low, span, holidays)
    rest = x.shape[1] - 2 - count
    prior = np.r_[np.full(2, 1e-6), np.full(count, 0.05 / CHANGEPOINT_SCALE), np.full(rest, 0.01)]
    inverse = np.linalg.inv(x.T @ x + np.diag(prior))
    beta = inverse @ x.T @ (y / scale)
    left = y / scale - x @ beta
    freedom = max(len(y) - float(np.trace(inverse @ (x.T @ x))), 1.0)
    variance = float(left @ left) / freedom
    ahead = _additive_design(np.array([d.toordinal() for d in future], dtype=float), future, knots, low, span, holidays)
    yhat = ahead @ beta
    half = NormalDist().inv_cdf(0.5 + confidence / 2) * np.sqrt(variance * (1 + np.einsum("ij,jk,ik->i", ahead, inverse, ahead)))
    return yhat * scale, (yhat - half) * scale, (yhat + half) * scale
