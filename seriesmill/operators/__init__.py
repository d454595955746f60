"""Operators over DataFrames of series, by family."""

from . import arima, decompose, diagnostics, features, smoothing, transforms  # noqa: F401
