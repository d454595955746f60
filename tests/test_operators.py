"""Spark operators against kernels, and their missing-value, key and error rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill import errors
from seriesmill.functions import udfs
from seriesmill.kernels import arma, diagnostics, holt, loess, panel, stl
from seriesmill.kernels.numbers import interpolate
from seriesmill.operators import arima as ar
from seriesmill.operators import decompose as de
from seriesmill.operators import diagnostics as di
from seriesmill.operators import features as fe
from seriesmill.operators import smoothing as sm
from seriesmill.operators import transforms as tr
from seriesmill.params import ArimaOptions, AutoArimaOptions, DecomposeOptions, HoltWintersOptions, LoessOptions, StlOptions
from seriesmill.sources import series as se

from .generators import arma as simulate
from .generators import frame, seasonal


@pytest.fixture(scope="module")
def panels():
    return {"a": seasonal(96, 12, 1), "b": seasonal(96, 12, 2) + 5, None: seasonal(60, 12, 3) + 8}


def column(df, key, name):
    return np.array([math.nan if r[name] is None else r[name] for r in df.where(F.col("k").eqNullSafe(key)).orderBy("t").collect()])


def test_z_score_and_scales(spark):
    y = [2.0, 4, 4, 4, 5, 5, 7, 9, None, math.nan, math.inf]
    df = frame(spark, {"a": y, "flat": [3.0, 3.0], "none": [None, math.nan], "one": [7.0]})
    got = {(r.k, r.ts): r for r in tr.z_score(df, ["k"], "y").collect()}
    sd = math.sqrt(32 / 7)
    assert [got["a", t].z for t in range(8)] == pytest.approx([(v - 5) / sd for v in y[:8]])
    assert got["a", 8].z is None and math.isnan(got["a", 9].z) and got["a", 10].z == math.inf
    assert got["flat", 0].z == 0 and got["one", 0].z == 0 and got["none", 0].z is None
    unit = {(r.k, r.ts): r.scaled for r in tr.min_max_scale(df, ["k"], "y").collect()}
    assert unit["a", 0] == 0 and unit["a", 7] == 1 and unit["flat", 1] == 0
    mid = {(r.k, r.ts): r.centered for r in tr.center(df, ["k"], "y").collect()}
    assert mid["a", 0] == -3 and mid["flat", 0] == 0


def test_scalers_apply_elsewhere_and_back(spark):
    fit, other = frame(spark, {"a": [1.0, 3.0], None: [5.0, 5.0]}), frame(spark, {"a": [5.0], None: [9.0], "new": [1.0]})
    for scaler, forward, want in ((tr.StandardScaler, "z", 3 / math.sqrt(2)), (tr.MinMaxScaler, "scaled", 2.0)):
        model = scaler(["k"], "y").fit(fit)
        out = {r.k: r for r in model.inverse_transform(model.transform(other)).collect()}
        assert out["a"][forward] == pytest.approx(want) and out["a"].y_back == pytest.approx(5)
        assert out[None][forward] == 0 and out[None].y_back == 5 and out["new"][forward] is None
        with pytest.raises(errors.OptionError):
            scaler(["k"], "y").transform(other)


def test_box_cox(spark):
    df = frame(spark, {"a": [1.0, 2.0, 4.0, None]})
    got = [r.transformed for r in tr.box_cox(df, "y", 0.5).orderBy("ts").collect()]
    assert got[:3] == pytest.approx([0, 2 * (math.sqrt(2) - 1), 2]) and got[3] is None
    odd = [r.transformed for r in tr.box_cox(frame(spark, {"a": [math.nan, math.inf, -math.inf]}), "y", 0).orderBy("ts").collect()]
    assert math.isnan(odd[0]) and odd[1] == math.inf and math.isnan(odd[2])
    back = tr.inv_box_cox(tr.box_cox(df, "y", -0.3), "transformed", -0.3).orderBy("ts").collect()
    assert [r.y_back for r in back][:3] == pytest.approx([1, 2, 4])
    with pytest.raises(Exception, match="NonPositive"):
        tr.box_cox(frame(spark, {"a": [0.0]}), "y", 0.5).collect()
    with pytest.raises(Exception, match="NonInvertible"):
        tr.inv_box_cox(frame(spark, {"a": [-9.0]}), "y", 0.5).collect()
    with pytest.raises(errors.OptionError):
        tr.BoxCox([], "y", "best")


def test_box_cox_by_key_with_failures(spark, panels):
    df = frame(spark, panels | {"bad": [-1.0, 2.0, 3.0]})
    model = tr.BoxCox(["k"], "y", "mle").fit(df, "ts", "null")
    params = {r.k: r for r in model.params.collect()}
    assert params["bad"]["lambda"] is None and params["bad"].error.startswith("NonPositive") and params["a"].error is None
    fixed = tr.BoxCox(["k"], "y", 0).fit(frame(spark, panels), "ts")
    out = fixed.inverse_transform(fixed.transform(frame(spark, panels))).where("abs(y - y_back) > 1e-9")
    assert out.count() == 0


def test_interpolation(spark):
    df = frame(spark, {"a": [None, 1.0, None, math.nan, 4.0, math.inf], "none": [None, None]})
    got = [r.filled for r in de.interpolate_missing(df, ["k"], "ts", "y").where("k = 'a'").orderBy("t").collect()]
    assert got == pytest.approx([1, 1, 2, 3, 4, 4])
    assert {r.filled for r in de.interpolate_missing(df, ["k"], "ts", "y").where("k = 'none'").collect()} == {None}


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
@pytest.mark.parametrize("period", [12, 5])
def test_classical_decomposition(spark, panels, mode, period):
    out = de.seasonal_decompose(frame(spark, panels), ["k"], "ts", "y", DecomposeOptions(period, mode))
    for key, y in panels.items():
        trend, season, rest = (column(out, key, c) for c in ("trend", "seasonal", "residual"))
        want = diagnostics.centred_average(y, period)
        assert np.allclose(trend, want, equal_nan=True)
        inside = ~np.isnan(trend)
        assert np.allclose((trend * season * rest if mode == "multiplicative" else trend + season + rest)[inside], y[inside])
        centre = season[:period].mean()
        assert centre == pytest.approx(1 if mode == "multiplicative" else 0, abs=1e-9)


def test_decomposition_rules_for_bad_series(spark, panels):
    bad = {"short": [1.0] * 23, "gap": [1.0] * 10 + [None] + [2.0] * 20, "ok": list(panels["a"]), "low": [0.0] * 30}
    out = de.seasonal_decompose(frame(spark, bad), ["k"], "ts", "y", DecomposeOptions(12, "multiplicative"), "null")
    found = {r.k: r.error for r in out.select("k", "error").distinct().collect()}
    assert found["ok"] is None and found["short"].startswith("SeriesTooShort") and found["gap"].startswith("NonFinite") and found["low"].startswith("NonPositive")
    assert out.where("k <> 'ok' and trend is not null").count() == 0
    with pytest.raises(Exception, match="SeriesTooShort|NonFinite"):
        de.seasonal_decompose(frame(spark, bad), ["k"], "ts", "y", DecomposeOptions(12)).collect()
    filled = de.seasonal_decompose(frame(spark, {"gap": bad["gap"]}), ["k"], "ts", "y", DecomposeOptions(12, missing="interpolate"))
    rows = filled.orderBy("t").collect()
    assert rows[10].residual is None and rows[10].trend is not None and rows[11].residual is not None


def test_stl_of_a_panel_equals_the_kernel(spark, panels):
    out = de.stl(frame(spark, panels), ["k"], "ts", "y", StlOptions(12, outer=1))
    for key, y in panels.items():
        for name, want in zip(("trend", "seasonal", "residual"), stl.stl_rows([y], StlOptions(12, outer=1))):
            assert np.allclose(column(out, key, name), want[0], atol=1e-9)


def test_failures_are_nulls_or_raise(spark, panels):
    df = frame(spark, {"ok": panels["a"], "short": [1.0, 2.0]})
    out = de.stl(df, ["k"], "ts", "y", StlOptions(12), "null")
    assert out.where("k = 'short' and trend is null and error like 'SeriesTooShort%'").count() == 2
    assert out.where("k = 'ok' and trend is not null and error is null").count() == 96
    with pytest.raises(Exception, match="SeriesTooShort"):
        de.stl(df, ["k"], "ts", "y", StlOptions(12)).collect()
    with pytest.raises(errors.OptionError):
        de.stl(df, ["k"], "ts", "y", StlOptions(12), "ignore")


def test_equal_times_are_an_error(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "k string, ts long, y double")
    with pytest.raises(Exception, match="same time"):
        sm.loess(df, ["k"], "ts", "y", LoessOptions(0.5)).collect()


def test_empty_frames(spark):
    none = frame(spark, {})
    assert de.stl(none, ["k"], "ts", "y", StlOptions(12)).count() == 0
    assert de.seasonal_decompose(none, ["k"], "ts", "y", DecomposeOptions(12)).count() == 0
    assert ar.forecast(ar.arima(none, ["k"], "ts", "y", ArimaOptions((1, 0, 0))), ["k"], 3).count() == 0
    assert fe.catch24(none, ["k"], "ts", "y").count() == 0 and tr.z_score(none, ["k"], "y").count() == 0
    assert di.kpss(none, ["k"], "ts", "y").count() == 0


@pytest.mark.parametrize("degree", [0, 1, 2])
def test_loess_of_a_panel(spark, panels, degree):
    out = sm.loess(frame(spark, panels), ["k"], "ts", "y", LoessOptions(0.3, degree))
    for key, y in panels.items():
        assert np.allclose(column(out, key, "smoothed"), loess.fit(y[None], loess.window(len(y), 0.3, degree), degree)[0], atol=1e-9)
    at = {(r.k, r.x): r.smoothed for r in sm.loess_at(frame(spark, panels), ["k"], "ts", "y", [-1.0, 7.5], LoessOptions(0.3, degree)).collect()}
    y = panels["b"]
    assert at["b", 7.5] == pytest.approx(loess.at_points(y, np.array([7.5]), loess.window(96, 0.3, degree), degree)[0])


def test_loess_missing_rules(spark):
    df = frame(spark, {"a": [1.0, None, 3.0, 4.0, 5.0]})
    with pytest.raises(Exception, match="NonFinite"):
        sm.loess(df, ["k"], "ts", "y", LoessOptions(0.8)).collect()
    out = sm.loess(df, ["k"], "ts", "y", LoessOptions(0.8), "interpolate")
    assert column(out, "a", "smoothed") == pytest.approx([1, 2, 3, 4, 5])


@pytest.mark.parametrize("o", [HoltWintersOptions(0.4), HoltWintersOptions(0.4, 0.2), HoltWintersOptions(0.3, 0.1, 0.2, 12), HoltWintersOptions(0.3, 0.0, 0.2, 12, "multiplicative")])
def test_holt_winters_and_its_forecast(spark, panels, o):
    fits = sm.holt_winters(frame(spark, panels), ["k"], "ts", "y", o)
    fitted, ahead = sm.holt_winters_fitted(fits, ["k"]), sm.holt_winters_forecast(fits, ["k"], 15, o)
    for key, y in panels.items():
        want = holt.run(y[None], o)
        assert np.allclose(column(fitted, key, "fitted"), want["fitted"][0])
        for r in ahead.where(F.col("k").eqNullSafe(key)).collect():
            line = want["level"][0] + r.h * want["trend"][0]
            if o.has_season:
                s = want["season"][0][(want["next_phase"][0] + r.h - 1) % 12]
                line = line + s if o.mode == "additive" else line * s
            assert r.forecast == pytest.approx(line)


def test_tests_of_a_panel(spark, panels):
    df = frame(spark, panels)
    for kind in ("constant", "trend"):
        for r in di.kpss(df, ["k"], "ts", "y", kind).collect():
            want = diagnostics.kpss(panels[r.k], kind)
            assert r.statistic == pytest.approx(want["statistic"]) and r.p_value == pytest.approx(want["p_value"]) and (r.lags, r.reject) == (want["lags"], want["reject"])
    for r in di.ljung_box(df, ["k"], "ts", "y", 8, 1).collect():
        want = diagnostics.ljung_box(panels[r.k], 8, 1)
        assert r.statistic == pytest.approx(want["statistic"]) and r.p_value == pytest.approx(want["p_value"], abs=1e-9) and r.df == 7
    assert {r.k: r.strength for r in di.seasonal_strength(df, ["k"], "ts", "y", 12).collect()} == pytest.approx({k: diagnostics.seasonal_strength(y, 12) for k, y in panels.items()})
    assert {r.k: r.d for r in di.ndiffs(df, ["k"], "ts", "y").collect()} == {k: diagnostics.ndiffs(y) for k, y in panels.items()}
    assert {r.k: r.seasonal_d for r in di.nsdiffs(df, ["k"], "ts", "y", 12).collect()} == {k: diagnostics.nsdiffs(y, 12) for k, y in panels.items()}
    with pytest.raises(Exception, match="three values"):
        di.kpss(frame(spark, {"a": [1.0, 2.0]}), ["k"], "ts", "y").collect()
    with pytest.raises(errors.InvalidLags):
        di.ljung_box(df, ["k"], "ts", "y", 0)


def test_arima_of_a_panel(spark):
    panels = {"a": simulate([0.6], [], 200, 1), None: np.cumsum(simulate([0.3], [], 150, 2))}
    o = ArimaOptions((1, 0, 0))
    fits = ar.arima(frame(spark, panels), ["k"], "ts", "y", o)
    got = {r.k: r for r in fits.collect()}
    ahead = ar.forecast(fits, ["k"], 6, 0.1)
    for key, y in panels.items():
        want = arma.fit_arima(y, o)
        assert got[key].phi == pytest.approx(list(want.phi)) and got[key].aicc == pytest.approx(want.aicc) and got[key].phi_se == pytest.approx(list(want.errors["phi"]))
        rows = ahead.where(F.col("k").eqNullSafe(key)).orderBy("h").collect()
        assert np.allclose([(r.mean, r.variance, r.lower, r.upper) for r in rows], np.stack(arma.forecast(want, 6, 0.1), axis=1))
    lb = {r.k: r for r in ar.ljung_box(fits, ["k"], 10).collect()}
    want = diagnostics.ljung_box(arma.fit_arima(panels["a"], o).residuals[1:], 10, 1)
    assert lb["a"].statistic == pytest.approx(want["statistic"]) and lb["a"].df == 9
    best = ar.auto_arima(frame(spark, {"a": panels["a"]}), ["k"], "ts", "y", AutoArimaOptions(max_p=2, max_q=1)).first()
    assert best.aicc <= got["a"].aicc + 1e-6
    failed = ar.arima(frame(spark, {"s": [1.0, 2.0]}), ["k"], "ts", "y", o, on_error="null").first()
    assert failed.phi is None and failed.error.startswith("SeriesTooShort")


def test_regressors_and_their_future(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=130)
    y = 2 + 3 * x[:120] + simulate([0.4], [], 120)
    rows = [("a", t, float(v), float(x[t])) for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, ts long, y double, x double")
    fits = ar.arima(df, ["k"], "ts", "y", ArimaOptions((1, 0, 0)), ["x"])
    assert fits.first().beta[0] == pytest.approx(3, abs=0.2)
    future = spark.createDataFrame([("a", t, float(x[t])) for t in range(120, 130)], "k string, ts long, x double")
    ahead = ar.forecast(fits, ["k"], 10, future=future, ts="ts", exog=["x"]).orderBy("h").collect()
    assert np.allclose([r.mean for r in ahead], 2 + 3 * x[120:], atol=1.5)
    with pytest.raises(Exception, match="ExogMismatch"):
        ar.forecast(fits, ["k"], 9, future=future, ts="ts", exog=["x"]).collect()


def test_difference(spark, panels):
    out = ar.difference(frame(spark, {"a": panels["a"]}), ["k"], "ts", "y", 1, 1, 12).orderBy("ts").collect()
    assert [r.diff for r in out[:13]] == [None] * 13
    assert np.allclose([r.diff for r in out[13:]], arma.difference(panels["a"], 1, 1, 12))


def test_feature_panel(spark, panels):
    df = frame(spark, panels)
    wide = {r.k: r for r in fe.catch24(df, ["k"], "ts", "y").collect()}
    for key, y in panels.items():
        assert np.allclose(list(wide[key])[1:], panel.features(y), equal_nan=True)
    long = fe.catch22(df, ["k"], "ts", "y", "long", True).collect()
    assert len(long) == 66 and {r.feature for r in long} == set(panel.SHORT_NAMES[:22])
    assert fe.feature(df, ["k"], "ts", "y", "trev").count() == 3
    with pytest.raises(errors.OptionError):
        fe.feature(df, ["k"], "ts", "y", "nothing")
    acf = fe.autocorrelation(df, ["k"], "ts", "y").where("k = 'a' and lag = 3").first()
    assert acf.acf == pytest.approx(panel.autocorrelation(panels["a"])[3])


def test_wide_frames(spark):
    a, b = seasonal(60, 12, 1), seasonal(60, 12, 2)
    wide = spark.createDataFrame([(t, float(a[t]), float(b[t])) for t in range(60)], "t long, a double, b double")
    smooth = sm.loess_batch(wide, "t", ["a", "b"], LoessOptions(0.4)).orderBy("t").collect()
    assert np.allclose([r.b for r in smooth], loess.fit(b[None], 24, 1)[0])
    parts = de.stl_batch(wide, "t", ["a", "b"], StlOptions(12))
    assert parts["trend"].columns == ["t", "a", "b"]
    assert np.allclose([r.a for r in parts["seasonal"].orderBy("t").collect()], stl.stl_rows([a], StlOptions(12))[1][0])
    classic = de.seasonal_decompose_batch(wide, "t", ["a", "b"], DecomposeOptions(12))["trend"].orderBy("t").collect()
    assert classic[0].a is None and classic[30].b == pytest.approx(diagnostics.centred_average(b, 12)[30])
    with pytest.raises(errors.WrongType):
        sm.loess_batch(wide.withColumn("a", F.col("a").cast("int")), "t", ["a"], LoessOptions(0.4))


def test_series_building(spark):
    rows = [("a", f"2024-01-0{d} 0{h}:30:00", 1.0) for d, h in ((1, 1), (1, 1), (1, 4), (2, 0))]
    df = spark.createDataFrame(rows, "k string, at string, v double").withColumn("at", F.to_timestamp_ntz("at"))
    hourly = se.bucket(df, "at", "hour", {"y": F.sum("v")}, ["k"])
    spine = se.indexed(se.on_spine(hourly, "hour", ["k"], {"y": 0.0}), ["k"], "ts").orderBy("t").collect()
    assert len(spine) == 24 and [r.y for r in spine[:4]] == [2, 0, 0, 1] and spine[23].t == 23
    packed = se.pack(hourly, ["k"], "ts", ["y"]).first()
    assert packed.n == 3 and packed.y == [2, 1, 1]


def test_sql_functions(spark, panels):
    udfs.register(spark)
    se.pack(frame(spark, {"a": panels["a"]}), ["k"], "ts", ["y"]).createOrReplaceTempView("packed")
    r = spark.sql("SELECT series_feature(y, 'trev') AS f, series_loess(y, 0.3D, 1) AS l, series_stl(y, 12) AS s, series_lambda(y) AS b, series_interpolate(y) AS i, series_features(y) AS all, series_ljung_box(y, 5) AS q, series_kpss(y) AS k FROM packed").first()
    y = panels["a"]
    assert r.f == pytest.approx(panel.feature(y, "trev")) and np.allclose(r.l, loess.fit(y[None], 29, 1)[0]) and len(r.s) == 3 and len(r.all) == 24 and r.i == pytest.approx(list(y))
    rows = spark.sql("SELECT h, mean FROM packed, LATERAL series_forecast(y, 1, 0, 0, 4)").collect()
    assert np.allclose([x.mean for x in sorted(rows)], arma.forecast(arma.fit_arima(y, ArimaOptions((1, 0, 0))), 4)[0])


def test_one_shuffle_by_key(spark, panels):
    plan = de.stl(frame(spark, panels), ["k"], "ts", "y", StlOptions(12))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_loess_fills_or_refuses_missing_values(spark):
    y = np.sin(np.arange(40) / 5)
    holed = y.copy()
    holed[[0, 11, 12]] = np.nan
    wide = spark.createDataFrame([(t, float(a), None if math.isnan(b) else float(b)) for t, (a, b) in enumerate(zip(y, holed))], "ts long, a double, b double")
    got = sm.loess_batch(wide, "ts", ["a", "b"], LoessOptions(0.4, 1), "interpolate").orderBy("ts").collect()
    filled = interpolate(holed)
    assert np.allclose([r.b for r in got], loess.fit(filled[None], loess.window(40, 0.4, 1), 1)[0])
    with pytest.raises(Exception, match="NonFinite|missing"):
        sm.loess_batch(wide, "ts", ["a", "b"], LoessOptions(0.4, 1)).collect()
