"""Scaling and Box-Cox transforms, all in Catalyst.

Statistics of a series are aggregated by key (partial sums before the shuffle, so a key
with most of the rows is no burden) and joined back; values are null where the input is
missing. A frame without keys (``by=[]``) is one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OptionError
from ..grouped import by_series
from ..kernels import boxcox
from ..sources.series import finite


def statistics(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """mean, sd (ddof 1; 0 of fewer than two values), min and max of the finite values;
    0 where there are none."""
    f = finite(F.col(y))
    zero = F.lit(0.0)
    sd = F.when(F.min(f) == F.max(f), zero).otherwise(F.coalesce(F.stddev_samp(f), zero))
    return df.groupBy(*by).agg(F.coalesce(F.avg(f), zero).alias("mean"), sd.alias("sd"), F.coalesce(F.min(f), zero).alias("min"), F.coalesce(F.max(f), zero).alias("max"))


def _joined(df: DataFrame, params: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``df`` with the parameters of its key under names that can't clash."""
    own = params.select(*[F.col(k).alias(f"__{k}") for k in by], *[F.col(n).alias(f"__p_{n}") for n in names])
    on = F.lit(True)
    for k in by:
        on = on & df[k].eqNullSafe(own[f"__{k}"])
    # without keys there is one row of parameters
    both = df.join(own, on, "left") if by else df.join(F.broadcast(own), F.lit(True), "left")
    return both.drop(*[f"__{k}" for k in by])


def _applied(df: DataFrame, params: DataFrame, by: list[str], names: list[str], out: str, value) -> DataFrame:
    p = {n: F.col(f"__p_{n}") for n in names}
    return _joined(df, params, by, names).withColumn(out, value(p)).drop(*[f"__p_{n}" for n in names])


def center(df: DataFrame, by: list[str], y: str, out: str = "centered") -> DataFrame:
    c = F.col(y).cast("double")
    return _applied(df, statistics(df, by, y), by, ["mean"], out, lambda p: c - p["mean"])


def _z(c: Column, p: dict) -> Column:
    # without spread the factor is 0: finite values become 0, infinite ones NaN
    return (c - p["mean"]) * F.when(p["sd"] == 0, 0.0).otherwise(F.try_divide(F.lit(1.0), p["sd"]))


def _unit(c: Column, p: dict) -> Column:
    spread = p["max"] - p["min"]
    return (c - p["min"]) * F.when(spread == 0, 0.0).otherwise(F.try_divide(F.lit(1.0), spread))


def z_score(df: DataFrame, by: list[str], y: str, out: str = "z") -> DataFrame:
    return _applied(df, statistics(df, by, y), by, ["mean", "sd"], out, lambda p: _z(F.col(y).cast("double"), p))


def min_max_scale(df: DataFrame, by: list[str], y: str, out: str = "scaled") -> DataFrame:
    return _applied(df, statistics(df, by, y), by, ["min", "max"], out, lambda p: _unit(F.col(y).cast("double"), p))


class _Scaler:
    names: list[str]

    def __init__(self, by: list[str], y: str):
        self.by, self.y, self.params = by, y, None

    def fit(self, df: DataFrame):
        self.params = statistics(df, self.by, self.y).select(*self.by, *self.names)
        return self

    def _fitted(self) -> DataFrame:
        if self.params is None:
            raise OptionError("fit has to come first")
        return self.params


class StandardScaler(_Scaler):
    """Means and standard deviations of one frame, applied to others."""

    names = ["mean", "sd"]

    def transform(self, df: DataFrame, out: str = "z") -> DataFrame:
        return _applied(df, self._fitted(), self.by, self.names, out, lambda p: _z(F.col(self.y).cast("double"), p))

    def inverse_transform(self, df: DataFrame, z: str = "z", out: str = "y_back") -> DataFrame:
        c = F.col(z)
        back = lambda p: F.when(F.isnan(c), c).when(p["sd"] == 0, F.when(c.isNotNull(), p["mean"])).otherwise(c * p["sd"] + p["mean"])
        return _applied(df, self._fitted(), self.by, self.names, out, back)


class MinMaxScaler(_Scaler):
    """Ranges of one frame, applied to others, whose values may leave [0, 1]."""

    names = ["min", "max"]

    def transform(self, df: DataFrame, out: str = "scaled") -> DataFrame:
        return _applied(df, self._fitted(), self.by, self.names, out, lambda p: _unit(F.col(self.y).cast("double"), p))

    def inverse_transform(self, df: DataFrame, z: str = "scaled", out: str = "y_back") -> DataFrame:
        c = F.col(z)
        back = lambda p: F.when(F.isnan(c), c).when(p["max"] == p["min"], F.when(c.isNotNull(), p["min"])).otherwise(c * (p["max"] - p["min"]) + p["min"])
        return _applied(df, self._fitted(), self.by, self.names, out, back)


def _power(c: Column, lam: Column) -> Column:
    """NaN stays NaN, and what isn't finite is not checked."""
    value = F.when(lam == 0, F.log(c)).otherwise((F.pow(c, lam) - 1) * F.try_divide(F.lit(1.0), lam))
    failed = F.raise_error(F.lit("NonPositive: Box-Cox needs values above 0")).cast("double")
    return F.when(F.isnan(c) | (c == float("-inf")), float("nan")).when(c <= 0, failed).otherwise(value)


def _unpower(c: Column, lam: Column) -> Column:
    base = 1 + lam * c
    failed = F.raise_error(F.lit("NonInvertible: 1 + lambda y is not above 0")).cast("double")
    value = F.when(lam == 0, F.exp(c)).when(F.isnan(base), base).when((base <= 0) & (F.abs(c) < float("inf")), failed)
    return value.otherwise(F.pow(base, F.try_divide(F.lit(1.0), lam)))


class BoxCox:
    """Box-Cox with a fixed exponent, or one chosen for each key by ``lam``: "mle",
    "pearsonr" or ("guerrero", period)."""

    def __init__(self, by: list[str], y: str, lam=0.0):
        if not (isinstance(lam, (int, float)) or lam in ("mle", "pearsonr") or (isinstance(lam, tuple) and lam[0] == "guerrero" and len(lam) == 2)):
            raise OptionError(f"lambda {lam!r} is not a number, 'mle', 'pearsonr' or ('guerrero', period)")
        self.by, self.y, self.lam, self.params = by, y, lam, None

    def fit(self, df: DataFrame, ts: str, on_error: str = "raise") -> "BoxCox":
        """Chooses the exponents; ``params`` has a row a key with ``lambda``."""
        if isinstance(self.lam, (int, float)):
            self.params = df.groupBy(*self.by).agg(F.lit(float(self.lam)).alias("lambda"))
        else:
            how = self.lam
            self.params = by_series(df, self.by, ts, [self.y], lambda y: {"lambda": boxcox.choose(y, how)}, "lambda double", on_error).drop("ts")
        return self

    def transform(self, df: DataFrame, out: str = "transformed") -> DataFrame:
        if self.params is None:
            raise OptionError("fit has to come first")
        return _applied(df, self.params, self.by, ["lambda"], out, lambda p: _power(F.col(self.y).cast("double"), p["lambda"]))

    def inverse_transform(self, df: DataFrame, z: str = "transformed", out: str = "y_back") -> DataFrame:
        if self.params is None:
            raise OptionError("fit has to come first")
        return _applied(df, self.params, self.by, ["lambda"], out, lambda p: _unpower(F.col(z), p["lambda"]))


def box_cox(df: DataFrame, y: str, lam: float, out: str = "transformed") -> DataFrame:
    """A fixed exponent needs no pass over the data: one projection."""
    return df.withColumn(out, _power(F.col(y).cast("double"), F.lit(float(lam))))


def inv_box_cox(df: DataFrame, y: str, lam: float, out: str = "y_back") -> DataFrame:
    return df.withColumn(out, _unpower(F.col(y).cast("double"), F.lit(float(lam))))
