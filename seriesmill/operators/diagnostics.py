"""Stationarity tests and residual diagnostics.

KPSS and Ljung-Box run in Catalyst on packed series: lagged products are folds over two
slices of one array. Differencing choices apply tests in turn, in a kernel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidLags, InvalidPeriod
from ..grouped import by_series
from ..kernels import diagnostics as kernel
from ..params import check_choice
from ..sources.series import pack


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _lagged_product(r: Column, n: Column, k: Column) -> Column:
    return _sum(F.zip_with(F.slice(r, k + 1, n - k), F.slice(r, F.lit(1), n - k), lambda a, b: a * b))


def kpss(df: DataFrame, by: list[str], ts: str, y: str, regression: str = "constant") -> DataFrame:
    """by, statistic, lags, critical_5pct, p_value, reject; fewer than three values or a
    missing one raise."""
    check_choice("regression", regression, ("constant", "trend"))
    p = pack(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"])
    good = F.forall("y", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.col("n") >= 3)
    p = p.withColumn("y", F.when(good, F.col("y")).otherwise(F.raise_error(F.lit("KPSS needs three values or more, all finite"))))
    n = F.col("n").cast("double")
    p = p.withColumn("mean", _sum(F.col("y")) / n)
    r = F.transform("y", lambda v: v - F.col("mean"))
    if regression == "trend":
        middle = (n - 1) / 2
        p = p.withColumn("slope", _sum(F.transform("y", lambda v, t: v * (t - middle))) / _sum(F.transform("y", lambda v, t: (t - middle) * (t - middle))))
        r = F.transform("y", lambda v, t: v - F.col("mean") - F.col("slope") * (t - middle))
    lags = F.least(F.greatest(F.lit(1), F.floor(12 * F.pow(n / 100, 0.25)).cast("int")), F.col("n") - 1)
    p = p.withColumns({"r": r, "lags": lags})
    p = p.withColumn("acov", F.transform(F.sequence(F.lit(0), F.col("lags")), lambda k: _lagged_product(F.col("r"), F.col("n"), k) / n))
    weights = F.transform("acov", lambda a, k: F.when(k == 0, a).otherwise(2 * (1 - k / (F.col("lags") + 1.0)) * a))
    # sums of squares of running sums, one fold
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    total = F.aggregate("r", zero, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + (a["s"] + v) * (a["s"] + v)).alias("q")), lambda a: a["q"])
    p = p.withColumn("statistic", F.try_divide(total, n * n * _sum(weights)))
    c, levels = kernel.CRITICAL[regression], kernel.LEVELS
    s = F.col("statistic")
    value = F.when(s >= c[0], levels[0])
    for i in range(3):
        value = value.when(s >= c[i + 1], levels[i] + (c[i] - s) / (c[i] - c[i + 1]) * (levels[i + 1] - levels[i]))
    value = value.when(s.isNotNull(), levels[3])
    return p.select(*by, "statistic", "lags", F.lit(c[2]).alias("critical_5pct"), value.alias("p_value"), (s > c[2]).alias("reject"))


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def chi2_tail(q: Column, df: Column) -> Column:
    z = (F.cbrt(q / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return F.when(q <= 0, 1.0).otherwise(F.least(F.greatest(1 - normal_cdf(z), F.lit(0.0)), F.lit(1.0)))


def ljung_box(df: DataFrame, by: list[str], ts: str, y: str, lags: int, fitted: int = 0) -> DataFrame:
    """by, statistic, df, p_value, lags; lags beyond the series' length count nothing."""
    if lags < 1:
        raise InvalidLags("at least one lag is needed")
    p = pack(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"])
    n = F.col("n").cast("double")
    p = p.withColumn("mean", _sum(F.col("y")) / n).withColumn("r", F.transform("y", lambda v: v - F.col("mean")))
    p = p.withColumn("total", _lagged_product(F.col("r"), F.col("n"), F.lit(0)))
    rho = lambda k: F.coalesce(F.try_divide(_lagged_product(F.col("r"), F.col("n"), k), F.col("total")), F.lit(0.0))
    terms = F.transform(F.filter(F.sequence(F.lit(1), F.lit(lags)), lambda k: k < F.col("n")), lambda k: F.pow(rho(k), 2.0) / (n - k))
    p = p.withColumn("statistic", n * (n + 2) * _sum(terms))
    free = max(1, lags - fitted)
    return p.select(*by, "statistic", F.lit(free).alias("df"), chi2_tail(F.col("statistic"), F.lit(float(free))).alias("p_value"), F.lit(lags).alias("lags"))


def seasonal_strength(df: DataFrame, by: list[str], ts: str, y: str, period: int) -> DataFrame:
    """by, strength: within [0, 1], and 0 for a series that can't be decomposed."""
    return by_series(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], lambda s: {"strength": kernel.seasonal_strength(s, period)}, "strength double").drop("ts")


def ndiffs(df: DataFrame, by: list[str], ts: str, y: str, most: int = 2) -> DataFrame:
    return by_series(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], lambda s: {"d": kernel.ndiffs(s, most)}, "d int").drop("ts")


def nsdiffs(df: DataFrame, by: list[str], ts: str, y: str, period: int, most: int = 1) -> DataFrame:
    if period < 2:
        raise InvalidPeriod(f"period {period} is under 2")
    return by_series(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], lambda s: {"seasonal_d": kernel.nsdiffs(s, period, most)}, "seasonal_d int").drop("ts")
