"""Exponential smoothing of equally long series, one step of time at once for all."""

from __future__ import annotations

import numpy as np

from ..errors import NonFinite, NonPositive, SeriesTooShort
from ..params import HoltWintersOptions


def check(y: np.ndarray, o: HoltWintersOptions) -> dict:
    if len(y):
        if not np.isfinite(y).all():
            raise NonFinite("the series has missing or infinite values")
        if o.mode == "multiplicative" and y.min() <= 0:
            raise NonPositive("the multiplicative mode needs values above 0")
        least = 2 * o.period if o.has_season else 2 if o.has_trend else 1
        if len(y) < least:
            raise SeriesTooShort(len(y), least)
    return {}


def start(y: np.ndarray, o: HoltWintersOptions):
    """Level, trend and season (rows x period) before the first step."""
    rows = len(y)
    trend = np.zeros(rows)
    season = np.zeros((rows, o.period if o.has_season else 0))
    if o.has_season:
        m = o.period
        level = y[:, :m].mean(axis=1)
        if o.has_trend:
            trend = (y[:, m : 2 * m].mean(axis=1) - level) / m
        season = y[:, :m] - level[:, None] if o.mode == "additive" else y[:, :m] / level[:, None]
    else:
        level = y[:, 0].copy()
        if o.has_trend:
            trend = y[:, 1] - y[:, 0]
    return level, trend, season.copy()


def step(now: np.ndarray, level, trend, season, phase: int, o: HoltWintersOptions):
    """The forecast of ``now`` and the state after it; ``season`` changes in place."""
    base = level + trend
    if o.has_season:
        s = season[:, phase].copy()
        told = base + s if o.mode == "additive" else base * s
        seen = now - s if o.mode == "additive" else now / s
    else:
        told, seen = base, now
    new = o.alpha * seen + (1 - o.alpha) * base
    if o.has_trend:
        trend = o.beta * (new - level) + (1 - o.beta) * trend
    if o.has_season:
        ratio = now - new if o.mode == "additive" else now / new
        season[:, phase] = o.gamma * ratio + (1 - o.gamma) * s
    return told, new, trend


def run(y: np.ndarray, o: HoltWintersOptions) -> dict:
    rows, n = y.shape
    if n == 0:
        return {"fitted": y, "level": np.full(rows, np.nan), "trend": np.zeros(rows), "season": np.zeros((rows, 0)), "next_phase": np.zeros(rows, int)}
    level, trend, season = start(y, o)
    fitted = np.empty_like(y)
    m = o.period if o.has_season else 1
    for t in range(n):
        fitted[:, t], level, trend = step(y[:, t], level, trend, season, t % m, o)
    return {"fitted": fitted, "level": level, "trend": trend, "season": season, "next_phase": np.full(rows, n % m)}
