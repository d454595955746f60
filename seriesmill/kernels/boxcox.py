"""Choosing the exponent of a Box-Cox transform."""

from __future__ import annotations

import numpy as np

from ..errors import InvalidPeriod, NonPositive, TooFewObservations
from .numbers import golden_minimum, normal_quantile


def transform(x: np.ndarray, lam: float) -> np.ndarray:
    return np.log(x) if lam == 0 else (np.power(x, lam) - 1) / lam


def _positive(y: np.ndarray, least: int) -> np.ndarray:
    x = y[np.isfinite(y)]
    if len(x) and x.min() <= 0:
        raise NonPositive("Box-Cox needs values above 0")
    if len(x) < least:
        raise TooFewObservations(f"{len(x)} finite values, at least {least} are needed")
    return x


def by_likelihood(y: np.ndarray) -> float:
    x = _positive(y, 2)
    logs = np.log(x)
    return golden_minimum(lambda lam: 0.5 * len(x) * np.log(max(transform(x, lam).var(), 1e-300)) - (lam - 1) * logs.sum(), -2.0, 2.0)


def by_correlation(y: np.ndarray) -> float:
    """Largest correlation of the sorted values with normal quantiles."""
    x = np.sort(_positive(y, 4))
    n = len(x)
    q = normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))

    def loss(lam: float) -> float:
        z = transform(x, lam)
        if lam < 0 and not np.isfinite(z).all():
            return np.inf
        spread = z.std() * q.std()
        return 0.0 if spread == 0 else -float(((z - z.mean()) * (q - q.mean())).mean() / spread)

    return golden_minimum(loss, -2.0, 2.0)


def by_blocks(y: np.ndarray, period: int) -> float:
    """Guerrero's criterion: the least variation of sd / mean**(1 - lambda) of blocks of
    one period from the start."""
    if period < 2:
        raise InvalidPeriod(f"period {period} is under 2")
    _positive(y, 1)
    blocks = len(y) // period
    if blocks < 2:
        raise TooFewObservations(f"{blocks} whole blocks, at least 2 are needed")
    cells = y[: blocks * period].reshape(blocks, period)
    mean, sd = cells.mean(axis=1), cells.std(axis=1, ddof=1)

    def loss(lam: float) -> float:
        ratio = sd / np.power(mean, 1 - lam)
        centre = ratio.mean()
        return np.inf if centre == 0 or not np.isfinite(centre) else float(ratio.std(ddof=1) / abs(centre))

    return golden_minimum(loss, -1.0, 2.0)


def choose(y: np.ndarray, how) -> float:
    """A number is itself; "mle", "pearsonr" or ("guerrero", period) are searches."""
    if how == "mle":
        return by_likelihood(y)
    if how == "pearsonr":
        return by_correlation(y)
    if isinstance(how, tuple) and how[0] == "guerrero":
        return by_blocks(y, how[1])
    _positive(y, 0)
    return float(how)
