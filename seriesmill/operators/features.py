"""The canonical feature panel of every series of a frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OptionError
from ..grouped import by_length, by_series
from ..kernels import panel


def _panel(df: DataFrame, by: list[str], ts: str, y: str, count: int, on_error: str) -> DataFrame:
    rows = df.select(*by, ts, F.col(y).alias("y"))
    return by_length(rows, by, ts, ["y"], panel.check, lambda s: {"x": panel.features_rows(s)[:, :count]}, "x array<double>", on_error)


def _shaped(rows: DataFrame, by: list[str], names: tuple[str, ...], form: str) -> DataFrame:
    extra = ["error"] if "error" in rows.columns else []
    if form == "wide":
        return rows.select(*by, *[F.col("x")[k].alias(n) for k, n in enumerate(names)], *extra)
    if form != "long":
        raise OptionError(f"form is {form!r}; it can be wide, long")
    named = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(n).alias("feature"), F.col("x")[k].alias("value")) for k, n in enumerate(names)])
    return rows.select(*by, F.explode(named).alias("f"), *extra).select(*by, "f.idx", "f.feature", "f.value", *extra)


def catch24(df: DataFrame, by: list[str], ts: str, y: str, form: str = "wide", short_names: bool = False, on_error: str = "raise") -> DataFrame:
    """22 features of the standardised series, and the raw mean and standard deviation:
    as columns, or as rows (idx, feature, value)."""
    return _shaped(_panel(df, by, ts, y, 24, on_error), by, panel.SHORT_NAMES if short_names else panel.NAMES, form)


def catch22(df: DataFrame, by: list[str], ts: str, y: str, form: str = "wide", short_names: bool = False, on_error: str = "raise") -> DataFrame:
    return _shaped(_panel(df, by, ts, y, 22, on_error), by, (panel.SHORT_NAMES if short_names else panel.NAMES)[:22], form)


def feature(df: DataFrame, by: list[str], ts: str, y: str, name: str, on_error: str = "raise") -> DataFrame:
    """by, value: one feature by its name or short name."""
    if name not in panel.NAMES and name not in panel.SHORT_NAMES:
        raise OptionError(f"there is no feature {name!r}")
    return by_series(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], lambda s: {"value": panel.feature(s, name)}, "value double", on_error).drop("ts")


def autocorrelation(df: DataFrame, by: list[str], ts: str, y: str) -> DataFrame:
    """by, lag, acf, and first_zero, the first lag at which it is not above 0."""

    def run(s: np.ndarray) -> dict:
        acf = panel.autocorrelation(s)
        return {"acf": acf, "first_zero": panel.first_zero(acf)}

    rows = by_series(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], run, "acf array<double>, first_zero int")
    return rows.select(*by, "first_zero", F.posexplode("acf").alias("lag", "acf"))
