"""Seasonal-trend decomposition by LOESS, over a matrix of equally long series."""

from __future__ import annotations

import numpy as np

from ..errors import EmptySeries, NonFinite, NonPositive, SeriesTooShort
from ..params import PERIODIC, StlOptions
from . import loess
from .numbers import interpolate


def _means(y: np.ndarray, window: int) -> np.ndarray:
    total = np.cumsum(np.pad(y, ((0, 0), (1, 0))), axis=1)
    return (total[:, window:] - total[:, :-window]) / window


def _cycles(d: np.ndarray, o: StlOptions, weights: np.ndarray | None) -> np.ndarray:
    """Smoothed cycle-subseries, one period longer at either end. Phases with equally
    many values are smoothed together."""
    rows, n = d.shape
    p = o.period
    out = np.zeros((rows, n + 2 * p))
    for phases in (range(n % p), range(n % p, p)):
        if not len(phases):
            continue
        m = len(range(phases[0], n, p))
        at = np.array(phases)[:, None] + p * np.arange(m)[None, :]
        sub = d[:, at].reshape(rows * len(phases), m)
        w = None if weights is None else weights[:, at].reshape(sub.shape)
        if o.seasonal == PERIODIC:
            mean = sub.mean(axis=1)
            if w is not None:
                total = w.sum(axis=1)
                mean = np.where(total > 0, (w * sub).sum(axis=1) / np.where(total > 0, total, 1), mean)
            smooth = np.repeat(mean[:, None], m + 2, axis=1)
        else:
            k = min(max(o.seasonal, 3), m)
            if o.seasonal_jump > 1 and m > 2:
                places = loess.jump_places(m, o.seasonal_jump)
                found = loess.fit_places(sub, np.concatenate([[-1], places, [m]]), k, 1, w)
                smooth = np.hstack([found[:, :1], loess.between(found[:, 1:-1], places, m), found[:, -1:]])
            else:
                smooth = loess.fit(sub, k, 1, w, 1, 1)
        place = np.array(phases)[:, None] + p * np.arange(m + 2)[None, :]
        out[:, place] = smooth.reshape(rows, len(phases), m + 2)
    return out


def _robust(residual: np.ndarray) -> np.ndarray:
    h = 6 * np.median(np.abs(residual), axis=1, keepdims=True)
    u = np.abs(residual) / np.where(h < loess.TINY, 1, h)
    return np.where(h < loess.TINY, 1.0, np.where(u < 1, (1 - u * u) ** 2, 0.0))


def decompose(y: np.ndarray, o: StlOptions):
    """trend, seasonal and residual of checked rows on the additive scale."""
    n, p = y.shape[1], o.period
    weights = None
    for outer in range(o.outer + 1):
        trend = np.zeros_like(y)
        for _ in range(o.inner):
            c = _cycles(y - trend, o, weights)
            low = _means(_means(_means(c, p), p), 3)
            seasonal = c[:, p : p + n] - loess.jumped(low, o.low_pass_window, 1, o.low_pass_jump)
            trend = loess.jumped(y - seasonal, o.trend_window, 1, o.trend_jump, weights)
        residual = y - trend - seasonal
        if outer < o.outer:
            weights = _robust(residual)
    return trend, seasonal, residual


def prepare(y: np.ndarray, o: StlOptions) -> np.ndarray:
    """One series, filled and checked."""
    if len(y) == 0:
        raise EmptySeries("the series is empty")
    if not np.isfinite(y).all():
        if o.missing == "error" or not np.isfinite(y).any():
            raise NonFinite("the series has missing or infinite values")
        y = interpolate(y)
    if len(y) < 2 * o.period:
        raise SeriesTooShort(len(y), 2 * o.period)
    if o.mode == "multiplicative" and y.min() <= 0:
        raise NonPositive("multiplicative decomposition needs values above 0")
    return y


def stl_rows(series: list[np.ndarray], o: StlOptions):
    """Results for prepared series of one length; NaN residuals where y was missing."""
    filled = np.stack([prepare(y, o) for y in series])
    log = o.mode == "multiplicative"
    parts = decompose(np.log(filled) if log else filled, o)
    trend, seasonal, residual = (np.exp(x) if log else x for x in parts)
    residual = np.where(np.isfinite(np.stack(series)), residual, np.nan)
    return trend, seasonal, residual
