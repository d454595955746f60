"""LOESS and exponential smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptySeries, NonFinite, OptionError
from ..grouped import by_length, by_series, exploded
from ..kernels import holt, loess as kernel
from ..kernels.numbers import interpolate
from ..params import HoltWintersOptions, LoessOptions
from ..sources.series import to_long, to_wide


def _checked(y: np.ndarray, missing: str) -> np.ndarray:
    if len(y) == 0:
        raise EmptySeries("the series is empty")
    if missing == "interpolate" and np.isfinite(y).any():
        y = interpolate(y)
    if not np.isfinite(y).all():
        raise NonFinite("the series has missing or infinite values")
    return y


def loess(df: DataFrame, by: list[str], ts: str, y: str, options: LoessOptions, missing: str = "error", on_error: str = "raise") -> DataFrame:
    """by, ts, t, y, smoothed. Equally long series of a batch share their weights."""
    if missing not in ("error", "interpolate"):
        raise OptionError(f"missing is {missing!r}")

    def run(series):
        rows = np.stack([_checked(s, missing) for s in series])
        k = kernel.window(rows.shape[1], options.span, options.degree)
        return {"y": series, "smoothed": kernel.fit(rows, k, options.degree)}

    rows = by_length(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], lambda s: {"ok": _checked(s, missing) is not None}, run, "y array<double>, smoothed array<double>", on_error)
    return exploded(rows, by, ["y", "smoothed"])


def loess_at(df: DataFrame, by: list[str], ts: str, y: str, points: list[float], options: LoessOptions, on_error: str = "raise") -> DataFrame:
    """by, x, smoothed: the fit at positions ``points``, which may lie between rows or
    beyond the ends."""
    x = np.array(points, float)

    def run(s):
        s = _checked(s, "error")
        return {"x": x, "smoothed": kernel.at_points(s, x, kernel.window(len(s), options.span, options.degree), options.degree)}

    rows = by_series(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], run, "x array<double>, smoothed array<double>", on_error)
    extra = ["error"] if on_error == "null" else []
    return rows.select(*by, *extra, F.explode(F.arrays_zip("x", "smoothed")).alias("r")).select(*by, "r.x", "r.smoothed", *extra)


def loess_batch(wide: DataFrame, ts: str, columns: list[str], options: LoessOptions, missing: str = "error") -> DataFrame:
    """The wide frame with each of ``columns`` smoothed; missing values fail the query, or
    with ``missing="interpolate"`` are filled first."""
    return to_wide(loess(to_long(wide, ts, columns), ["series"], "ts", "y", options, missing), ts, columns, "smoothed")


STATE = "fitted array<double>, level double, trend double, season array<double>, next_phase int"


def holt_winters(df: DataFrame, by: list[str], ts: str, y: str, options: HoltWintersOptions, on_error: str = "raise") -> DataFrame:
    """One row a key: ts and fitted as arrays, and the state after the last value. An
    empty series has an empty fit."""

    def run(series):
        return holt.run(np.stack(series), options)

    return by_length(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], lambda s: holt.check(s, options), run, STATE, on_error)


def holt_winters_fitted(fits: DataFrame, by: list[str]) -> DataFrame:
    return exploded(fits, by, ["fitted"])


def holt_winters_forecast(fits: DataFrame, by: list[str], steps: int, options: HoltWintersOptions) -> DataFrame:
    """by, h, forecast for 1 .. steps, in Catalyst from the state alone."""
    rows = fits.select(*by, "level", "trend", "season", "next_phase", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("h"))
    line = F.col("level") + F.col("h") * F.col("trend")
    if options.has_season:
        s = F.element_at("season", F.pmod(F.col("next_phase") + F.col("h") - 1, F.lit(options.period)) + 1)
        line = line + s if options.mode == "additive" else line * s
    return rows.select(*by, "h", line.alias("forecast"))
