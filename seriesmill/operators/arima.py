"""ARIMA models of every series of a frame: fit, forecast, order search.

A fit is one row a key and holds all that a forecast needs, so forecasting is a function
of rows alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExogMismatch, OptionError
from ..grouped import by_series
from ..kernels import arma
from ..kernels.diagnostics import ljung_box as portmanteau
from ..params import ArimaOptions, AutoArimaOptions
from ..sources.series import pack

FIT = (
    "p int, d int, q int, seasonal_p int, seasonal_d int, seasonal_q int, period int, constant boolean, method string, "
    "phi array<double>, theta array<double>, seasonal_phi array<double>, seasonal_theta array<double>, beta array<double>, intercept double, "
    "phi_se array<double>, theta_se array<double>, seasonal_phi_se array<double>, seasonal_theta_se array<double>, beta_se array<double>, intercept_se double, "
    "sigma2 double, log_likelihood double, aic double, aicc double, bic double, n_obs int, "
    "fitted array<double>, residuals array<double>, fitted_onestep array<double>, last_obs array<double>, w_tail array<double>, eps_tail array<double>"
)


def _row(f: arma.Fit) -> dict:
    o = f.options
    out = {"p": o.order[0], "d": o.order[1], "q": o.order[2], "seasonal_p": o.seasonal[0], "seasonal_d": o.seasonal[1], "seasonal_q": o.seasonal[2], "period": o.period, "constant": o.constant, "method": o.method}
    names = ("phi", "theta", "seasonal_phi", "seasonal_theta", "beta", "intercept", "sigma2", "log_likelihood", "aic", "aicc", "bic", "n_obs", "fitted", "residuals", "fitted_onestep", "last_obs", "w_tail", "eps_tail")
    out |= {n: getattr(f, n) for n in names}
    for n in ("phi", "theta", "seasonal_phi", "seasonal_theta", "beta"):
        out[f"{n}_se"] = f.errors.get(n, np.full(len(getattr(f, n)), np.nan))
    out["intercept_se"] = float(f.errors["intercept"][0]) if "intercept" in f.errors else float("nan")
    return out


def _fit_of(r: dict) -> arma.Fit:
    a = lambda n: np.array(r[n], float)
    o = ArimaOptions((r["p"], r["d"], r["q"]), (r["seasonal_p"], r["seasonal_d"], r["seasonal_q"]), r["period"], bool(r["constant"]), r["method"])
    none = np.zeros(0)
    return arma.Fit(o, a("phi"), a("theta"), a("seasonal_phi"), a("seasonal_theta"), a("beta"), r["intercept"], r["sigma2"], r["log_likelihood"], r["aic"], r["aicc"], r["bic"], r["n_obs"], none, none, none, {}, a("last_obs"), a("w_tail"), a("eps_tail"))


def arima(df: DataFrame, by: list[str], ts: str, y: str, options: ArimaOptions, exog: list[str] | None = None, on_error: str = "raise", se_convention: str = "reference") -> DataFrame:
    """One row a key with the fit's fields. ``exog`` are columns of regressors; with them
    a constant is always fitted."""
    if se_convention not in ("reference", "mle"):
        raise OptionError(f"se_convention is {se_convention!r}")
    exog = exog or []

    def run(s, *x):
        return _row(arma.fit_arima(s, options, np.stack(x, axis=1) if x else None, convention=se_convention))

    return by_series(df, by, ts, [y, *exog], run, FIT, on_error)


def auto_arima(df: DataFrame, by: list[str], ts: str, y: str, options: AutoArimaOptions | None = None, on_error: str = "raise") -> DataFrame:
    """One row a key with the fit of the least AICc found."""
    options = options or AutoArimaOptions()
    return by_series(df, by, ts, [y], lambda s: _row(arma.auto_arima(s, options)), FIT, on_error)


def forecast(fits: DataFrame, by: list[str], steps: int, alpha: float = 0.05, future: DataFrame | None = None, ts: str | None = None, exog: list[str] | None = None) -> DataFrame:
    """by, h, mean, variance, lower, upper for 1 .. steps, from rows of fits. Models with
    regressors need ``future``: rows of by, ``ts`` and ``exog``, ``steps`` of them a key."""
    if not 0 < alpha < 1:
        raise OptionError(f"alpha {alpha} is not in (0, 1)")
    if steps < 1:
        raise OptionError("at least one step is needed")
    rows = fits.drop("ts", "fitted", "residuals", "fitted_onestep")
    if "error" in rows.columns:
        rows = rows.where("error is null").drop("error")
    exog = exog or []
    if future is not None:
        coming = pack(future, by, ts, exog).drop("ts", "n").select(*[F.col(k).alias(f"__{k}") for k in by], F.array(*exog).alias("__x"))
        on = F.lit(True)
        for k in by:
            on = on & rows[k].eqNullSafe(coming[f"__{k}"])
        rows = (rows.join(coming, on, "left") if by else rows.join(F.broadcast(coming), F.lit(True), "left")).drop(*[f"__{k}" for k in by])
    schema = T.StructType([*[rows.schema[k] for k in by], *T._parse_datatype_string("h int, mean double, variance double, lower double, upper double").fields])

    def run(batches):
        for pdf in batches:
            parts = []
            for r in pdf.to_dict("records"):
                x = r.get("__x")
                if x is not None and any(len(c) != steps for c in x):
                    raise ExogMismatch(f"{steps} future rows are needed for each key")
                x = np.array([np.array(c, float) for c in x]).T if x is not None else None
                mean, variance, lower, upper = arma.forecast(_fit_of(r), steps, alpha, x)
                parts.append(pd.DataFrame({**{k: [r[k]] * steps for k in by}, "h": np.arange(1, steps + 1, dtype=np.int32), "mean": mean, "variance": variance, "lower": lower, "upper": upper}))
            if parts:
                yield pd.concat(parts)[[f.name for f in schema.fields]]

    return rows.mapInPandas(run, schema)


def ljung_box(fits: DataFrame, by: list[str], lags: int) -> DataFrame:
    """The portmanteau test of a fit's residuals without its warm-up."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                warm = r["d"] + r["seasonal_d"] * r["period"] + max(r["p"], r["q"]) + r["seasonal_p"] * r["period"]
                got = portmanteau(np.array(r["residuals"], float)[warm:], lags, r["p"] + r["q"] + r["seasonal_p"] + r["seasonal_q"])
                out.append({**{k: r[k] for k in by}, **got})
            if out:
                yield pd.DataFrame(out)[[f.name for f in schema.fields]]

    rows = fits.select(*by, "residuals", "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "period")
    schema = T.StructType([*[rows.schema[k] for k in by], *T._parse_datatype_string("statistic double, df int, p_value double, lags int").fields])
    return rows.mapInPandas(run, schema)


def difference(df: DataFrame, by: list[str], ts: str, y: str, d: int = 0, seasonal_d: int = 0, period: int = 0, out: str = "diff") -> DataFrame:
    """The full differencing in Catalyst: one window, a weighted sum of lags; null for
    the first d + seasonal_d * period rows."""
    own = Window.partitionBy(*by).orderBy(ts)
    poly = arma.difference_polynomial(d, seasonal_d, period)
    value = F.lit(0.0)
    for k, c in enumerate(poly.tolist()):
        if c:
            value = value + c * (F.lag(F.col(y).cast("double"), k).over(own) if k else F.col(y).cast("double"))
    return df.withColumn(out, value)
