"""The registered queries: each operator on a canonical series, and its DuckDB twin where
SQL can express it. Doubles are rounded on both sides; NaN leaves as null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import arima as ar
from ..operators import decompose as de
from ..operators import diagnostics as di
from ..operators import features as fe
from ..operators import smoothing as sm
from ..operators import transforms as tr
from ..kernels import panel
from ..params import ArimaOptions, AutoArimaOptions, DecomposeOptions, HoltWintersOptions, LoessOptions, StlOptions
from ..sources.series import finite
from . import inputs as i
from . import oracles

QUERIES: dict = {}
ORACLES: dict = dict(oracles.ORACLES)


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(finite(F.col(c)), places) + 0.0 for c in columns})


# --- transforms --------------------------------------------------------------------------


@query
def center(spark, d):
    return rounded(tr.center(i.orders_month(spark, d), [], "y"), "centered").select("t", "centered")


@query
def z_score(spark, d):
    return rounded(tr.z_score(i.orders_month(spark, d), [], "y"), "z").select("t", "z")


@query
def min_max(spark, d):
    return rounded(tr.min_max_scale(i.orders_month(spark, d), [], "y"), "scaled").select("t", "scaled")


@query
def z_score_panel(spark, d):
    return rounded(tr.z_score(i.orders_priority(spark, d), ["p"], "y"), "z").select("p", "t", "z")


@query
def standard_scaler_train_test(spark, d):
    s = i.orders_month(spark, d)
    scaler = tr.StandardScaler([], "y").fit(s.where("t < 60"))
    out = scaler.inverse_transform(scaler.transform(s.where("t >= 60")))
    return rounded(out, "z", "y_back").select("t", "z", "y_back")


@query
def min_max_scaler_inverse(spark, d):
    s = i.orders_month(spark, d)
    scaler = tr.MinMaxScaler([], "y").fit(s.where("t < 60"))
    out = scaler.inverse_transform(scaler.transform(s.where("t >= 60")))
    return rounded(out, "scaled", "y_back").select("t", "scaled", "y_back")


@query
def box_cox_l0(spark, d):
    return rounded(tr.box_cox(i.orders_month(spark, d), "y", 0.0), "transformed").select("t", "transformed")


@query
def box_cox_l05(spark, d):
    return rounded(tr.box_cox(i.orders_month(spark, d), "y", 0.5), "transformed").select("t", "transformed")


@query
def inv_box_cox_roundtrip(spark, d):
    return rounded(tr.inv_box_cox(tr.box_cox(i.orders_month(spark, d), "y", 0.3), "transformed", 0.3), "y_back").select("t", "y_back")


def _lambda(spark, d, how):
    params = tr.BoxCox(["k"], "y", how).fit(i.lineitem_month(spark, d), "ts").params
    return params.select("k", F.round("lambda", 4).alias("lam"))


@query
def box_cox_mle(spark, d):
    return _lambda(spark, d, "mle")


@query
def box_cox_pearsonr(spark, d):
    return _lambda(spark, d, "pearsonr")


@query
def box_cox_guerrero(spark, d):
    return _lambda(spark, d, ("guerrero", 12))


@query
def box_cox_fitted_roundtrip(spark, d):
    s = i.lineitem_month(spark, d)
    model = tr.BoxCox(["k"], "y", "mle").fit(s, "ts")
    return rounded(model.inverse_transform(model.transform(s)), "y_back", places=6).select("k", "t", "y_back")


# --- decomposition -----------------------------------------------------------------------


@query
def interpolate_missing(spark, d):
    return rounded(de.interpolate_missing(i.orders_priority(spark, d).drop("t"), ["p"], "ts", "y"), "filled", places=5).select("p", "t", "filled")


def _parts(df, *keys):
    # cents of means often end in a tie at more places
    return rounded(df, "trend", "seasonal", "residual", places=5).select(*keys, "t", "trend", "seasonal", "residual")


@query
def sd_additive(spark, d):
    return _parts(de.seasonal_decompose(i.orders_month(spark, d), [], "ts", "y", DecomposeOptions(12)))


@query
def sd_multiplicative(spark, d):
    return _parts(de.seasonal_decompose(i.orders_month(spark, d), [], "ts", "y", DecomposeOptions(12, "multiplicative")))


@query
def sd_odd_period(spark, d):
    return _parts(de.seasonal_decompose(i.orders_month(spark, d), [], "ts", "y", DecomposeOptions(5)))


@query
def sd_interpolate(spark, d):
    return _parts(de.seasonal_decompose(i.orders_priority(spark, d), ["p"], "ts", "y", DecomposeOptions(12, missing="interpolate")), "p")


@query
def sd_batch_wide(spark, d):
    wide = i.orders_priority(spark, d).groupBy("t").pivot("p", i.PRIORITIES).agg(F.first("y"))
    for k, p in enumerate(i.PRIORITIES):
        wide = wide.withColumnRenamed(p, f"p{k + 1}")
    names = [f"p{k + 1}" for k in range(5)]
    out = de.seasonal_decompose_batch(wide, "t", names, DecomposeOptions(12, missing="interpolate"))["trend"]
    return rounded(out, *names, places=5)


def _stl(spark, d, **options):
    return rounded(de.stl(i.orders_month(spark, d), [], "ts", "y", StlOptions(12, **options)), "trend", "seasonal", "residual", places=6).select("t", "trend", "seasonal", "residual")


@query
def stl_additive(spark, d):
    return _stl(spark, d)


@query
def stl_multiplicative(spark, d):
    return _stl(spark, d, mode="multiplicative")


@query
def stl_robust(spark, d):
    return rounded(de.stl(i.orders_month(spark, d), [], "ts", "y", StlOptions(12, outer=5)), "trend", "seasonal", "residual", places=6).select("t", "trend", "seasonal", "residual")


@query
def stl_periodic(spark, d):
    return _stl(spark, d, seasonal="periodic")


@query
def stl_jump(spark, d):
    return _stl(spark, d, seasonal_jump=2, trend_jump=3, low_pass_jump=2)


@query
def stl_interpolate(spark, d):
    out = de.stl(i.orders_priority(spark, d).drop("t"), ["p"], "ts", "y", StlOptions(12, missing="interpolate"))
    return rounded(out, "trend", "seasonal", "residual", places=6).select("p", "t", "trend", "seasonal", "residual")


@query
def stl_events_panel(spark, d):
    out = de.stl(i.events_type(spark, d).drop("t"), ["k"], "ts", "y", StlOptions(24))
    return rounded(out, "trend", "seasonal", "residual", places=6).select("k", "t", "trend", "seasonal", "residual")


@query
def stl_batch_wide(spark, d):
    wide = i.events_type(spark, d).groupBy("t").pivot("k").agg(F.first("y")).fillna(0.0)
    names = sorted(c for c in wide.columns if c != "t")
    return rounded(de.stl_batch(wide, "t", names, StlOptions(24))["seasonal"], *names, places=6)


# --- smoothing ---------------------------------------------------------------------------


def _loess(spark, d, degree):
    return rounded(sm.loess(i.events_hour(spark, d), [], "ts", "y", LoessOptions(0.3, degree)), "smoothed", places=6).select("t", "smoothed")


@query
def loess_d0(spark, d):
    return _loess(spark, d, 0)


@query
def loess_d1(spark, d):
    return _loess(spark, d, 1)


@query
def loess_d2(spark, d):
    return _loess(spark, d, 2)


@query
def loess_at(spark, d):
    points = [-2.0, 0.5, 10.25, 39.5, 79.0, 83.0]
    return rounded(sm.loess_at(i.orders_month(spark, d), [], "ts", "y", points, LoessOptions(0.4, 1)), "smoothed", places=6).select("x", "smoothed")


@query
def loess_batch_wide(spark, d):
    wide = i.events_type(spark, d).groupBy("t").pivot("k").agg(F.first("y")).fillna(0.0)
    names = sorted(c for c in wide.columns if c != "t")
    return rounded(sm.loess_batch(wide, "t", names, LoessOptions(0.2, 1)), *names, places=6)


HW = {
    "hw_ses": HoltWintersOptions(0.4),
    "hw_holt": HoltWintersOptions(0.4, 0.2),
    "hw_additive": HoltWintersOptions(0.3, 0.1, 0.2, 12),
    "hw_multiplicative": HoltWintersOptions(0.3, 0.1, 0.2, 12, "multiplicative"),
    "hw_seasonal_only": HoltWintersOptions(0.3, 0.0, 0.2, 12),
}


def _hw(name):
    def run(spark, d):
        fits = sm.holt_winters(i.orders_month(spark, d), [], "ts", "y", HW[name])
        return rounded(sm.holt_winters_fitted(fits, []), "fitted").select("t", "fitted")

    run.__name__ = name
    return query(run)


for _name in HW:
    _hw(_name)


@query
def hw_forecast(spark, d):
    fits = sm.holt_winters(i.orders_month(spark, d), [], "ts", "y", HW["hw_additive"])
    return rounded(sm.holt_winters_forecast(fits, [], 18, HW["hw_additive"]), "forecast")


# --- tests -------------------------------------------------------------------------------


def _kpss(spark, d, kind):
    out = rounded(di.kpss(i.events_hour(spark, d), [], "ts", "y", kind), "statistic", "p_value")
    return out.select("statistic", F.col("lags").cast("int").alias("lags"), "critical_5pct", "p_value", "reject")


@query
def kpss_c(spark, d):
    return _kpss(spark, d, "constant")


@query
def kpss_ct(spark, d):
    return _kpss(spark, d, "trend")


@query
def ljung_box(spark, d):
    return rounded(di.ljung_box(i.events_hour(spark, d), [], "ts", "y", 12, 2), "statistic", "p_value", places=6)


@query
def seasonal_strength(spark, d):
    return rounded(di.seasonal_strength(i.orders_month(spark, d), [], "ts", "y", 12), "strength")


@query
def ndiffs(spark, d):
    return di.ndiffs(i.orders_month(spark, d), [], "ts", "y")


@query
def nsdiffs(spark, d):
    return di.nsdiffs(i.orders_month(spark, d), [], "ts", "y", 12)


# --- features ----------------------------------------------------------------------------


def _feature(name):
    def run(spark, d):
        return rounded(fe.feature(i.events_hour(spark, d), [], "ts", "y", name), "value", places=6)

    run.__name__ = f"c22_{name}"
    return query(run)


for _name in panel.SHORT_NAMES:
    _feature(_name)


@query
def catch22_panel(spark, d):
    names = [f"f{k:02d}" for k in range(22)]
    out = fe.catch22(i.events_type(spark, d), ["k"], "ts", "y")
    out = out.toDF("k", *names)
    return rounded(out, *names, places=6)


@query
def catch24_long(spark, d):
    return rounded(fe.catch24(i.events_type(spark, d), ["k"], "ts", "y", "long", True), "value", places=6)


@query
def acf_first_zero(spark, d):
    return rounded(fe.autocorrelation(i.events_hour(spark, d), [], "ts", "y"), "acf").select("lag", "acf", "first_zero")


# --- ARIMA -------------------------------------------------------------------------------


@query
def diff_seasonal(spark, d):
    out = ar.difference(i.orders_month(spark, d), [], "ts", "y", 1, 1, 12)
    return rounded(out, "diff").select("t", "diff")


@query
def arima_010_drift(spark, d):
    fits = ar.arima(i.orders_month(spark, d), [], "ts", "y", ArimaOptions((0, 1, 0)))
    return rounded(ar.forecast(fits, [], 12), "mean", "variance", places=6).select("h", "mean", "variance")


@query
def arima_100_css(spark, d):
    fits = ar.arima(i.orders_month(spark, d), [], "ts", "y", ArimaOptions((1, 0, 0)))
    out = fits.select(F.col("phi")[0].alias("phi"), "intercept", "sigma2", "log_likelihood", "aic", "aicc", "bic", "n_obs")
    return rounded(out, "phi", "intercept", "sigma2", "log_likelihood", "aic", "aicc", "bic", places=5)


def _summary(fits: DataFrame, options: ArimaOptions) -> DataFrame:
    """k, the coefficients as ar1, ... and ma1, ... (seasonal ones last), and the fit's figures."""
    (p, _, q), (sp, _, sq) = options.order, options.seasonal
    ar = [F.concat("phi", "seasonal_phi")[n].alias(f"ar{n + 1}") for n in range(p + sp)]
    ma = [F.concat("theta", "seasonal_theta")[n].alias(f"ma{n + 1}") for n in range(q + sq)]
    out = fits.select("k", *ar, *ma, "intercept", "sigma2", "aicc", "n_obs")
    return rounded(out, *out.columns[1:-1], places=3)


def _arima(name, options):
    def run(spark, d):
        return _summary(ar.arima(i.lineitem_month(spark, d), ["k"], "ts", "y", options), options)

    run.__name__ = name
    return query(run)


_arima("arima_111_css", ArimaOptions((1, 1, 1)))
_arima("arima_mle", ArimaOptions((1, 0, 1), method="mle"))
_arima("arima_cssml", ArimaOptions((2, 0, 0), method="css-mle"))
_arima("sarima_airline", ArimaOptions((0, 1, 1), (0, 1, 1), 12, constant=False))
_arima("sarima_mle", ArimaOptions((1, 0, 0), (1, 0, 0), 12, method="mle"))


def _exog(spark, d):
    orders = i.bucket(i.table(spark, d, "orders"), "o_orderdate", "month", {"y": F.sum("o_totalprice") / 1e6, "x1": F.count("*").cast("double")})
    return i.indexed(orders, [], "ts").withColumn("x2", F.col("t").cast("double"))


@query
def arimax(spark, d):
    s = _exog(spark, d)
    fits = ar.arima(s, [], "ts", "y", ArimaOptions((1, 0, 0)), ["x1", "x2"])
    out = fits.select(F.col("beta")[0].alias("beta1"), F.col("beta")[1].alias("beta2"), "intercept", F.col("phi")[0].alias("phi"), "sigma2", "n_obs")
    return rounded(out, "beta1", "beta2", "intercept", "phi", "sigma2", places=3)


@query
def arimax_forecast(spark, d):
    s = _exog(spark, d)
    fits = ar.arima(s.where("t < 68"), [], "ts", "y", ArimaOptions((1, 0, 0)), ["x1", "x2"])
    return rounded(ar.forecast(fits, [], 12, future=s.where("t >= 68"), ts="ts", exog=["x1", "x2"]), "mean", "variance", "lower", "upper", places=3)


@query
def arima_forecast(spark, d):
    fits = ar.arima(i.orders_month(spark, d), [], "ts", "y", ArimaOptions((1, 0, 0)))
    return rounded(ar.forecast(fits, [], 12), "mean", places=5).select("h", "mean")


@query
def arima_intervals(spark, d):
    fits = ar.arima(i.orders_month(spark, d), [], "ts", "y", ArimaOptions((1, 0, 0)))
    return rounded(ar.forecast(fits, [], 12, 0.1), "variance", "lower", "upper", places=5).select("h", "variance", "lower", "upper")


@query
def arima_ljung_box(spark, d):
    fits = ar.arima(i.orders_month(spark, d), [], "ts", "y", ArimaOptions((1, 0, 0)))
    return rounded(ar.ljung_box(fits, [], 10), "statistic", "p_value", places=4)


@query
def auto_arima(spark, d):
    fits = ar.auto_arima(i.lineitem_month(spark, d), ["k"], "ts", "y", AutoArimaOptions())
    return rounded(fits.select("k", "p", "d", "q", "aicc", "n_obs"), "aicc", places=3)


@query
def auto_arima_seasonal(spark, d):
    fits = ar.auto_arima(i.orders_month(spark, d), [], "ts", "y", AutoArimaOptions(12, max_p=2, max_q=2, max_seasonal_p=1, max_seasonal_q=1))
    return rounded(fits.select("p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "aicc", "n_obs"), "aicc", places=3)


# --- SQL functions -----------------------------------------------------------------------


@query
def sql_functions(spark, d):
    """The registered functions, called from SQL on packed series."""
    udfs.register(spark)
    udfs.pack(i.events_type(spark, d), ["k"], "ts", ["y"]).createOrReplaceTempView("packed_events")
    out = spark.sql("SELECT k, series_feature(y, 'trev') AS trev, element_at(series_loess(y, 0.3D, 1), 1) AS first_smooth, element_at(series_holt_winters(y, 0.4D, 0.1D, 0.0D, 0), 3) AS third, series_kpss(y) AS kpss FROM packed_events")
    return rounded(out, "trev", "first_smooth", "third", "kpss", places=6)


@query
def sql_forecast_table(spark, d):
    """A table function of forecasts, lateral to packed series."""
    udfs.register(spark)
    udfs.pack(i.lineitem_month(spark, d), ["k"], "ts", ["y"]).createOrReplaceTempView("packed_months")
    out = spark.sql("SELECT k, h, mean FROM packed_months, LATERAL series_forecast(y, 1, 0, 0, 6)")
    return rounded(out, "mean", places=3)
