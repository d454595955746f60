"""Seeded series."""

import numpy as np


def seasonal(n, period, seed=1, noise=0.5):
    rng = np.random.default_rng(seed)
    phase = 2 * np.pi * (np.arange(n) % period) / period
    return 10 + 0.05 * np.arange(n) + 3 * np.sin(phase) + 1.5 * np.cos(2 * phase) + noise * rng.normal(size=n)


def arma(ar, ma, n, seed=1, burn=200):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + burn)
    w = np.zeros(n + burn)
    for t in range(n + burn):
        w[t] = e[t] + sum(a * w[t - k - 1] for k, a in enumerate(ar) if t > k) + sum(b * e[t - k - 1] for k, b in enumerate(ma) if t > k)
    return w[burn:]


def frame(spark, series: dict):
    """(k, ts, y) of arrays by key."""
    rows = [(k, t, None if v is None else float(v)) for k, s in series.items() for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "k string, ts long, y double")
