"""SQL functions over packed series (ARRAY<DOUBLE>), batched by Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels import arma, boxcox, diagnostics, holt, loess, panel, stl
from ..kernels.numbers import interpolate
from ..params import ArimaOptions, HoltWintersOptions, LoessOptions, StlOptions
from ..sources.series import pack  # noqa: F401  (the packed form these functions take)


def _each(f, *columns) -> pd.Series:
    return pd.Series([None if args[0] is None else f(np.array(args[0], float), *args[1:]) for args in zip(*columns)])


def series_loess(y: pd.Series, span: pd.Series, degree: pd.Series) -> pd.Series:
    def one(s, span, degree):
        o = LoessOptions(float(span), int(degree))
        return loess.fit(s[None, :], loess.window(len(s), o.span, o.degree), o.degree)[0].tolist()

    return _each(one, y, span, degree)


def series_holt_winters(y: pd.Series, alpha: pd.Series, beta: pd.Series, gamma: pd.Series, period: pd.Series) -> pd.Series:
    def one(s, alpha, beta, gamma, period):
        o = HoltWintersOptions(float(alpha), float(beta), float(gamma), int(period))
        holt.check(s, o)
        return holt.run(s[None, :], o)["fitted"][0].tolist()

    return _each(one, y, alpha, beta, gamma, period)


def series_stl(y: pd.Series, period: pd.Series) -> pd.Series:
    return _each(lambda s, p: [part[0].tolist() for part in stl.stl_rows([s], StlOptions(int(p)))], y, period)


def series_interpolate(y: pd.Series) -> pd.Series:
    return _each(lambda s: interpolate(s).tolist(), y)


def series_lambda(y: pd.Series) -> pd.Series:
    return _each(boxcox.by_likelihood, y).astype(float)


def series_feature(y: pd.Series, name: pd.Series) -> pd.Series:
    return _each(panel.feature, y, name).astype(float)


def series_features(y: pd.Series) -> pd.Series:
    return _each(lambda s: panel.features(s).tolist(), y)


def series_kpss(y: pd.Series) -> pd.Series:
    return _each(lambda s: diagnostics.kpss(s)["statistic"], y).astype(float)


def series_ljung_box(y: pd.Series, lags: pd.Series) -> pd.Series:
    return _each(lambda s, k: diagnostics.ljung_box(s, int(k))["p_value"], y, lags).astype(float)


class SeriesForecast:
    """Rows (h, mean, variance, lower, upper) of an ARIMA(p, d, q) of a packed series."""

    def eval(self, y, p: int, d: int, q: int, steps: int):
        fit = arma.fit_arima(np.array(y, float), ArimaOptions((p, d, q)), errors=False)
        for h, row in enumerate(zip(*arma.forecast(fit, steps)), 1):
            yield (h, *map(float, row))


SCALARS = {
    series_loess: "array<double>",
    series_holt_winters: "array<double>",
    series_stl: "array<array<double>>",
    series_interpolate: "array<double>",
    series_lambda: "double",
    series_feature: "double",
    series_features: "array<double>",
    series_kpss: "double",
    series_ljung_box: "double",
}


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session's SQL under their names."""
    for f, kind in SCALARS.items():
        spark.udf.register(f.__name__, F.pandas_udf(f, kind))
    spark.udtf.register("series_forecast", F.udtf(SeriesForecast, returnType="h int, mean double, variance double, lower double, upper double"))
