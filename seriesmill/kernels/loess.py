"""Local polynomial regression on an even grid.

The window of a point is centred by index, so all inner points of a series share one
row of weights: their sums are correlations of the series with that row, and only the
points near the ends have rows of their own. Series are rows of a matrix throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

TINY = 1e-12


def tricube(n: int, x: np.ndarray, k: int):
    """First index, distances and weights of the windows of ``k`` of ``n`` around x."""
    half = k // 2
    low = np.clip(np.floor(np.clip(x, 0, n - 1) - half), 0, n - k).astype(np.int64)
    d = low[:, None] + np.arange(k)[None, :] - x[:, None]
    reach = np.maximum(np.maximum(x - low, low + k - 1 - x), 1.0) + 1.0
    u = np.abs(d) / reach[:, None]
    return low, d, np.where(u < 1, (1 - u**3) ** 3, 0.0)


@lru_cache(maxsize=64)
def _plan(n: int, k: int, before: int, after: int):
    """The points -before .. n-1+after: those that share a row of weights, and the ends
    in two groups, whose windows are the first and the last ``k`` values."""
    x = np.arange(-before, n + after, dtype=float)
    half = k // 2
    inner = (x >= half) & (x <= n - k + half) & (x >= 0) & (x <= n - 1)
    groups = []
    if inner.any():
        groups.append((np.flatnonzero(inner), None, *tricube(n, np.array([float(half)]), k)[1:]))
    ends = np.flatnonzero(~inner)
    low, d, w = tricube(n, x[ends], k)
    for first in dict.fromkeys(low.tolist()):
        on = low == first
        groups.append((ends[on], first, d[on], w[on]))
    return x, groups


def _solve(s: list[np.ndarray], t: list[np.ndarray], degree: int, nearest: np.ndarray) -> np.ndarray:
    """Intercepts from the weighted sums of powers (s) and of powers times y (t)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = t[0] / s[0]
        out = mean
        if degree == 1:
            # elimination with the larger first pivot, as of a 2 x 2 system
            pivot = np.maximum(np.abs(s[0]), np.abs(s[1]))
            second = np.abs(s[0] * s[2] - s[1] ** 2) / pivot
            line = (s[2] * t[0] - s[1] * t[1]) / (s[0] * s[2] - s[1] ** 2)
            out = np.where((pivot >= TINY) & (second >= TINY), line, mean)
        elif degree == 2:
            a = np.stack([np.stack([s[0], s[1], s[2]], -1), np.stack([s[1], s[2], s[3]], -1), np.stack([s[2], s[3], s[4]], -1)], -2)
            b = np.stack(t, -1)[..., None]
            det = s[0] * (s[2] * s[4] - s[3] ** 2) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] ** 2)
            ok = np.abs(det) >= TINY
            a = np.where(ok[..., None, None], a, np.eye(3))
            out = np.where(ok, np.linalg.solve(a, b)[..., 0, 0], mean)
        return np.where(s[0] > 0, out, nearest)


def _coefficients(d: np.ndarray, w: np.ndarray, degree: int) -> np.ndarray:
    """The fit as a weighted sum of the window's values: a row for each point."""
    powers = [np.ones_like(d), d, d * d]
    s = [(w * d**p).sum(axis=1) for p in range(2 * degree + 1)]
    unit = [np.eye(degree + 1)[p] for p in range(degree + 1)]
    parts = [_solve(s, [np.full(len(d), u[p]) for p in range(degree + 1)], degree, np.zeros(len(d))) for u in unit]
    return w * sum(part[:, None] * power for part, power in zip(parts, powers))


@lru_cache(maxsize=64)
def _rows(n: int, k: int, degree: int, before: int, after: int):
    return [(points, first, _coefficients(d, w, degree)) for points, first, d, w in _plan(n, k, before, after)[1]]


def _slide(y: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums over all windows of each row, times the columns of ``kernel`` (k x columns)."""
    n, k = y.shape[1], len(kernel)
    if k * (n - k + 1) <= 20_000:
        return sliding_window_view(y, k, axis=1) @ kernel
    size = 1 << (n + k - 2).bit_length()
    f = np.fft.rfft(y, size)
    g = np.fft.rfft(kernel[::-1], size, axis=0)
    return np.stack([np.fft.irfft(f * g[:, c], size)[:, k - 1 : n] for c in range(kernel.shape[1])], axis=-1)


def fit(y: np.ndarray, k: int, degree: int, weights: np.ndarray | None = None, before: int = 0, after: int = 0) -> np.ndarray:
    """Smoothed rows of ``y`` (series x n) at -before .. n-1+after, from windows of
    ``k``; ``weights`` are further weights of the same shape."""
    rows, n = y.shape
    out = np.empty((rows, n + before + after))
    if weights is None:
        for points, first, c in _rows(n, k, degree, before, after):
            out[:, points] = _slide(y, c.T)[..., 0] if first is None else y[:, first : first + k] @ c.T
        return out
    x, groups = _plan(n, k, before, after)
    wy = y * weights
    nearest = y[:, np.clip(np.round(x), 0, n - 1).astype(int)]
    for points, first, d, w in groups:
        f = [w * d**p for p in range(2 * degree + 1)]
        if first is None:
            kernel = np.stack([g[0] for g in f], axis=1)
            s, t = (np.moveaxis(_slide(v, kernel[:, :c]), -1, 0) for v, c in ((weights, 2 * degree + 1), (wy, degree + 1)))
            s[0][s[0] < TINY] = 0
        else:
            s = [weights[:, first : first + k] @ g.T for g in f]
            t = [wy[:, first : first + k] @ g.T for g in f[: degree + 1]]
        out[:, points] = _solve(list(s), list(t), degree, nearest[:, points])
    return out


def at_points(y: np.ndarray, x: np.ndarray, k: int, degree: int) -> np.ndarray:
    """One series at any points; beyond its ends the window stays at the end."""
    n = len(y)
    low, d, w = tricube(n, x, k)
    at = low[:, None] + np.arange(k)[None, :]
    s = [(w * d**p).sum(axis=1) for p in range(2 * degree + 1)]
    t = [(w * d**p * y[at]).sum(axis=1) for p in range(degree + 1)]
    return _solve(s, t, degree, y[np.clip(np.round(x), 0, n - 1).astype(int)])


def window(n: int, span: float, degree: int) -> int:
    return min(n, max(int(np.ceil(span * n)), degree + 2))


def fit_places(y: np.ndarray, x: np.ndarray, k: int, degree: int, weights: np.ndarray | None = None) -> np.ndarray:
    """As ``fit``, at the places ``x`` alone."""
    rows, n = y.shape
    low, d, w = tricube(n, x.astype(float), k)
    at = low[:, None] + np.arange(k)[None, :]
    nearest = np.clip(x, 0, n - 1)
    if weights is None:
        c = _coefficients(d, w, degree)
    out = np.empty((rows, len(x)))
    step = max(1, 2_000_000 // at.size)  # rows whose windows are held at once
    for r in range(0, rows, step):
        part = y[r : r + step, at]
        if weights is None:
            out[r : r + step] = (part * c).sum(axis=2)
            continue
        v = weights[r : r + step, at] * w
        s = [(v * d**p).sum(axis=2) for p in range(2 * degree + 1)]
        t = [(v * d**p * part).sum(axis=2) for p in range(degree + 1)]
        out[r : r + step] = _solve(s, t, degree, y[r : r + step, nearest])
    return out


def jump_places(n: int, jump: int) -> np.ndarray:
    return np.unique(np.append(np.arange(0, n, jump), n - 1))


def jumped(y: np.ndarray, k: int, degree: int, jump: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Fits at every ``jump``-th point and the last alone, lines between."""
    n = y.shape[1]
    k = min(max(k, degree + 2), n)
    if jump <= 1:
        return fit(y, k, degree, weights)
    at = jump_places(n, jump)
    return between(fit_places(y, at, k, degree, weights), at, n)


def between(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Values at the rising places ``at`` (the first 0, the last n - 1) and lines between."""
    if len(at) == 1:
        return values
    grid = np.arange(n)
    left = np.clip(np.searchsorted(at, grid, "right") - 1, 0, len(at) - 2)
    share = (grid - at[left]) / (at[left + 1] - at[left])
    return values[:, left] + share * (values[:, left + 1] - values[:, left])
