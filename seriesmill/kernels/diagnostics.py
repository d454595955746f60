"""Stationarity tests and the choice of differencing."""

from __future__ import annotations

import numpy as np

from ..errors import InvalidLags, NonFinite, SeriesTooShort
from .numbers import chi2_tail

# Critical values at 1, 2.5, 5 and 10 percent.
CRITICAL = {"constant": (0.739, 0.574, 0.463, 0.347), "trend": (0.216, 0.176, 0.146, 0.119)}
LEVELS = (0.01, 0.025, 0.05, 0.10)


def kpss(y: np.ndarray, regression: str = "constant") -> dict:
    n = len(y)
    if n < 3:
        raise SeriesTooShort(n, 3)
    if not np.isfinite(y).all():
        raise NonFinite("the series has missing or infinite values")
    t = np.arange(n) - (n - 1) / 2
    r = y - y.mean()
    if regression == "trend":
        r = r - (t @ r) / (t @ t) * t
    lags = min(max(1, int(12 * (n / 100) ** 0.25)), n - 1)
    acov = np.array([r[k:] @ r[: n - k] for k in range(lags + 1)]) / n
    s2 = acov[0] + 2 * ((1 - np.arange(1, lags + 1) / (lags + 1)) @ acov[1:])
    with np.errstate(divide="ignore", invalid="ignore"):
        statistic = float((np.cumsum(r) ** 2).sum() / (n * n * s2))
    critical = CRITICAL[regression]
    p = float(np.interp(statistic, critical[::-1], LEVELS[::-1])) if statistic == statistic else float("nan")
    return {"statistic": statistic, "lags": lags, "critical_5pct": critical[2], "p_value": p, "reject": bool(statistic > critical[2])}


def ndiffs(y: np.ndarray, most: int = 2) -> int:
    for d in range(most):
        if len(y) < 8 or not kpss(y)["reject"]:
            return d
        y = np.diff(y)
    return most


def centred_average(y: np.ndarray, period: int) -> np.ndarray:
    """Moving average over one period, NaN at the ends; an even period halves its ends."""
    h = period // 2
    weights = np.ones(period) if period % 2 else np.concatenate([[0.5], np.ones(period - 1), [0.5]])
    out = np.full(len(y), np.nan)
    if len(y) >= len(weights):
        out[h : len(y) - h] = np.convolve(y, weights / period, "valid")
    return out


def seasonal_strength(y: np.ndarray, period: int) -> float:
    """1 - Var(R) / Var(S + R) of the additive decomposition, within [0, 1]; 0 where the
    series can't be decomposed."""
    n = len(y)
    if period < 2 or n < 2 * period or not np.isfinite(y).all():
        return 0.0
    rest = y - centred_average(y, period)
    phase = np.arange(n) % period
    good = np.isfinite(rest)
    count = np.bincount(phase[good], minlength=period)
    pattern = np.bincount(phase[good], rest[good], period) / np.maximum(count, 1)
    s = (pattern - pattern.mean())[phase]
    r = rest[good] - s[good]
    whole = np.var(r + s[good])
    return float(min(max(1 - np.var(r) / whole, 0.0), 1.0)) if whole > 0 else 0.0


def nsdiffs(y: np.ndarray, period: int, most: int = 1) -> int:
    for d in range(most):
        if len(y) < 2 * period or not seasonal_strength(y, period) > 0.64:
            return d
        y = y[period:] - y[:-period]
    return most


def ljung_box(r: np.ndarray, lags: int, fitted: int = 0) -> dict:
    if lags < 1:
        raise InvalidLags("at least one lag is needed")
    n = len(r)
    c = r - r.mean() if n else r
    total = float(c @ c)
    lags_used = min(lags, n - 1)
    q = 0.0
    for k in range(1, lags_used + 1):
        rho = float(c[k:] @ c[:-k]) / total if total > 0 else 0.0
        q += rho * rho / (n - k)
    q *= n * (n + 2)
    df = max(1, lags - fitted)
    return {"statistic": q, "df": df, "p_value": chi2_tail(q, df), "lags": lags}
