import numpy as np
import pytest

from seriesmill import errors
from seriesmill.kernels import arma, optimise, diagnostics
from seriesmill.params import ArimaOptions, AutoArimaOptions

from .generators import arma as simulate
from .generators import seasonal


def test_partial_autocorrelations_go_both_ways():
    rng = np.random.default_rng(0)
    for k in range(1, 6):
        x = rng.normal(size=k)
        ar = arma.stationary(x)
        assert np.allclose(arma.unconstrained(ar), x)
        assert np.abs(np.roots(np.concatenate([-ar[::-1], [1.0]]))).min() > 1


def naive_residuals(w, ar, ma):
    start, e = max(len(ar), len(ma)), np.zeros(len(w))
    for t in range(start, len(w)):
        e[t] = w[t] - sum(a * w[t - j - 1] for j, a in enumerate(ar)) - sum(b * e[t - j - 1] for j, b in enumerate(ma))
    return e


@pytest.mark.parametrize("ar,ma", [([0.5], []), ([], [0.9]), ([0.3, -0.2], [0.4, 0.1, -0.3]), ([], [0.2] + [0] * 10 + [0.99])])
def test_residuals_equal_the_recursion(ar, ma):
    w = np.random.default_rng(1).normal(size=900)
    assert np.allclose(arma.residuals(w, np.array(ar), np.array(ma)), naive_residuals(w, ar, ma), atol=1e-9)


@pytest.mark.parametrize("ar,ma", [([0.5], []), ([], [0.6]), ([0.7, -0.3], [0.4]), ([0.2], [0.3, 0.2])])
def test_likelihood_equals_the_dense_gaussian(ar, ma):
    ar, ma, n = np.array(ar), np.array(ma), 40
    w = simulate(ar, ma, n)
    psi = arma.psi_weights(ar, ma, 3000)
    cov = np.array([psi[: 3000 - h] @ psi[h:] for h in range(n)])[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    s2 = w @ np.linalg.solve(cov, w) / n
    value, sigma2 = arma.likelihood(w, ar, ma)
    assert value == pytest.approx(n * np.log(s2) + np.linalg.slogdet(cov)[1], abs=1e-6) and sigma2 == pytest.approx(s2)


def test_a_steady_filter_is_the_full_one():
    w = simulate([0.5, -0.3], [0.4, 0.3], 400)
    quick, full = (arma.Kalman(np.array([0.5, -0.3]), np.array([0.4, 0.3]), 400, t) for t in (1e-13, -1.0))
    assert len(quick.f) < 100 and len(full.f) == 400
    assert np.allclose(quick.errors(w), full.errors(w), atol=1e-9) and np.allclose(quick.variances(), full.variances())


@pytest.mark.parametrize("seed", [29, 57])
def test_a_sum_of_squares_that_falls_to_a_unit_root_is_taken_at_the_limit(seed):
    t = np.arange(80)
    y = 0.3 * t + 4 * np.sin(t * np.pi / 6) + np.random.default_rng(seed).normal(size=80)
    fit = arma.fit_arima(y, ArimaOptions((0, 1, 1), (0, 1, 1), 12, constant=False))

    def cost(theta, seasonal_theta):
        ma = arma.combined(np.array([theta]), np.array([seasonal_theta]), 12, 1.0)
        return (naive_residuals(arma.difference(y, 1, 1, 12), [], ma) ** 2).sum()

    best = fit.seasonal_theta[0]
    assert fit.theta[0] == pytest.approx(-0.9999, abs=1e-12)
    assert cost(-1.0, best) < cost(-0.9999, best) < cost(-0.9998, best)
    assert fit.sigma2 * fit.n_obs == pytest.approx(cost(-0.9999, best), rel=1e-12)
    assert all(cost(-0.9999, best + step) >= cost(-0.9999, best) for step in (-1e-6, 1e-6))


def test_a_slow_search_is_finished_exactly():
    """Large residuals at the minimum, where steps by the Jacobian alone become small."""
    def residuals(x):
        return np.array([x[0] ** 2 - 3.0, 2.0 * x[0] - 9.0, x[0] * x[1] + 20.0, x[1] - 1.0])

    def slopes(x, r):
        return np.array([[2 * x[0], 0.0], [2.0, 0.0], [x[1], x[0]], [0.0, 1.0]])

    x = optimise.newton(residuals, slopes, optimise.least_squares(residuals, np.array([2.0, -5.0]), slopes=slopes)[0])
    assert np.abs(slopes(x, None).T @ residuals(x)).max() < 1e-8


def test_seasonal_products():
    assert np.allclose(arma.combined(np.array([0.5]), np.array([0.4]), 4, -1.0), [0.5, 0, 0, 0.4, -0.2])
    assert np.allclose(arma.combined(np.array([0.5]), np.array([0.4]), 4, 1.0), [0.5, 0, 0, 0.4, 0.2])
    y = np.random.default_rng(0).normal(size=60)
    w = arma.difference(y, 1, 1, 4)
    poly = arma.difference_polynomial(1, 1, 4)
    assert np.allclose(np.convolve(y, poly)[5:60], w) and np.allclose(arma._integrate(w, y[:5], poly), y)


@pytest.mark.parametrize("method", ["css", "mle", "css-mle"])
def test_coefficients_are_recovered(method):
    fit = arma.fit_arima(simulate([0.6], [], 2000), ArimaOptions((1, 0, 0), method=method))
    assert fit.phi[0] == pytest.approx(0.6, abs=0.06) and fit.sigma2 == pytest.approx(1, abs=0.1)
    fit = arma.fit_arima(simulate([0.5], [0.4], 3000, 3), ArimaOptions((1, 0, 1), method=method))
    assert fit.phi[0] == pytest.approx(0.5, abs=0.08) and fit.theta[0] == pytest.approx(0.4, abs=0.08)


def airline(n, theta, seasonal_theta, seed=2):
    w = simulate([], arma.combined(np.array([theta]), np.array([seasonal_theta]), 12, 1.0), n, seed)
    return arma._integrate(w, np.zeros(13), arma.difference_polynomial(1, 1, 12))


@pytest.mark.parametrize("method", ["css", "mle"])
def test_airline_model(method):
    fit = arma.fit_arima(airline(600, -0.4, -0.5), ArimaOptions((0, 1, 1), (0, 1, 1), 12, False, method))
    assert fit.theta[0] == pytest.approx(-0.4, abs=0.12) and fit.seasonal_theta[0] == pytest.approx(-0.5, abs=0.12)


def test_no_parameters_is_closed_form():
    y = np.cumsum(0.3 + np.random.default_rng(0).normal(size=100))
    fit = arma.fit_arima(y, ArimaOptions((0, 1, 0)))
    step = np.diff(y)
    assert fit.intercept == pytest.approx(step.mean()) and fit.sigma2 == pytest.approx(step.var())
    mean, variance, lower, upper = arma.forecast(fit, 5)
    assert np.allclose(mean, y[-1] + step.mean() * np.arange(1, 6)) and np.allclose(variance, step.var() * np.arange(1, 6))
    assert (lower < mean).all() and (mean < upper).all() and (np.diff(upper - lower) > 0).all()
    assert np.allclose(fit.fitted, y[0] + step.mean() * np.arange(100)) and np.allclose(fit.fitted_onestep[1:], y[:-1] + step.mean())


def test_ar1_is_regression_on_the_last_value():
    y = simulate([0.5], [], 200)
    w = y - y.mean()
    fit = arma.fit_arima(y, ArimaOptions((1, 0, 0)))
    assert fit.phi[0] == pytest.approx((w[1:] @ w[:-1]) / (w[:-1] @ w[:-1]), abs=1e-7)
    k, m = 3, 199
    assert fit.aic == pytest.approx(2 * k + m * (np.log(2 * np.pi * fit.sigma2) + 1)) and fit.n_obs == m
    assert np.allclose(arma.forecast(fit, 4)[0], y.mean() + fit.phi[0] ** np.arange(1, 5) * w[-1])


def test_standard_errors_and_their_conventions():
    y = simulate([0.5], [], 1000)
    one = arma.fit_arima(y, ArimaOptions((1, 0, 0), method="mle"))
    two = arma.fit_arima(y, ArimaOptions((1, 0, 0), method="mle"), convention="mle")
    assert two.errors["phi"][0] == pytest.approx(np.sqrt((1 - 0.25) / 1000), rel=0.1)
    assert two.errors["phi"][0] / one.errors["phi"][0] == pytest.approx(np.sqrt(2))
    assert np.isnan(arma.fit_arima(np.cumsum(y), ArimaOptions((1, 1, 0))).errors["intercept"][0])


def test_regressors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + simulate([0.6], [], 400)
    fit = arma.fit_arima(y, ArimaOptions((1, 0, 0)), x)
    assert np.allclose(fit.beta, [2, -1], atol=0.15) and fit.phi[0] == pytest.approx(0.6, abs=0.1)
    future = rng.normal(size=(3, 2))
    mean, *_ = arma.forecast(fit, 3, exog=future)
    rest = y[-1] - fit.intercept - x[-1] @ fit.beta
    assert np.allclose(mean, fit.intercept + future @ fit.beta + rest * fit.phi[0] ** np.arange(1, 4))
    with pytest.raises(errors.ExogMismatch):
        arma.forecast(fit, 3)
    with pytest.raises(errors.ExogMismatch):
        arma.fit_arima(y, ArimaOptions((1, 0, 0)), x[:-1])
    with pytest.raises(errors.SingularModel):
        arma.fit_arima(y, ArimaOptions((1, 0, 0)), np.ones((400, 1)))


@pytest.mark.parametrize("order,seasonal,period", [((11, 0, 0), (0, 0, 0), 0), ((0, 3, 0), (0, 0, 0), 0), ((0, 0, -1), (0, 0, 0), 0), ((0, 0, 0), (1, 0, 0), 0), ((0, 0, 0), (0, -1, 0), 4)])
def test_bad_orders(order, seasonal, period):
    with pytest.raises(errors.InvalidOrder):
        ArimaOptions(order, seasonal, period)


def test_data_errors():
    with pytest.raises(errors.SeriesTooShort):
        arma.fit_arima(np.arange(4.0), ArimaOptions((2, 1, 0)))
    with pytest.raises(errors.NonFinite):
        arma.fit_arima(np.array([1.0, np.nan] * 10), ArimaOptions((1, 0, 0)))


def test_order_search_is_no_worse_than_its_neighbours():
    y = np.cumsum(simulate([0.6], [], 300, 7))
    fit = arma.auto_arima(y, AutoArimaOptions(max_p=3, max_q=3))
    o = fit.options
    assert o.order[1] == 1
    for p, q in ((o.order[0] + 1, o.order[2]), (o.order[0], o.order[2] + 1), (max(o.order[0] - 1, 0), o.order[2])):
        if p <= 3 and q <= 3:
            assert fit.aicc <= arma.fit_arima(y, ArimaOptions((p, 1, q), constant=o.constant)).aicc + 1e-6


def test_optimisers_find_minima():
    rosen = lambda x: 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2
    start = np.array([-1.2, 1.0])
    assert np.allclose(optimise.simplex(rosen, start)[0], 1, atol=1e-4)
    assert np.allclose(optimise.quasi_newton(rosen, start)[0], 1, atol=1e-3)
    assert np.allclose(optimise.least_squares(lambda x: np.array([10 * (x[1] - x[0] ** 2), 1 - x[0]]), start)[0], 1, atol=1e-6)
    assert np.allclose(optimise.hessian(rosen, np.ones(2)), [[802, -400], [-400, 200]], rtol=1e-4)


def test_kpss_and_differencing():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=300)
    assert not diagnostics.kpss(noise)["reject"] and diagnostics.kpss(np.cumsum(noise))["reject"]
    assert not diagnostics.kpss(noise + 0.5 * np.arange(300), "trend")["reject"] and diagnostics.kpss(noise + 0.5 * np.arange(300))["reject"]
    assert diagnostics.ndiffs(noise) == 0 and diagnostics.ndiffs(np.cumsum(noise)) == 1 and diagnostics.ndiffs(np.cumsum(np.cumsum(noise))) == 2
    strong = seasonal(120, 12, noise=0.1)
    assert diagnostics.seasonal_strength(strong, 12) > 0.9 and diagnostics.nsdiffs(strong, 12) == 1
    assert diagnostics.seasonal_strength(noise[:120], 12) < 0.64 and diagnostics.nsdiffs(noise[:120], 12) == 0
    assert diagnostics.seasonal_strength(noise[:10], 12) == 0 and diagnostics.seasonal_strength(np.ones(40), 4) == 0


def test_ljung_box():
    rng = np.random.default_rng(0)
    noise, related = rng.normal(size=500), simulate([0.7], [], 500)
    assert diagnostics.ljung_box(noise, 10)["p_value"] > 0.01 and diagnostics.ljung_box(related, 10)["p_value"] < 1e-6
    assert diagnostics.ljung_box(noise, 10, 3)["df"] == 7
    with pytest.raises(errors.InvalidLags):
        diagnostics.ljung_box(noise, 0)


def test_likelihoods_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(3)
    for p, q, n in ((0, 0, 30), (1, 1, 200), (2, 3, 200), (13, 1, 60), (0, 13, 300), (3, 0, 5)):
        ar = [arma.stationary(rng.normal(size=p)) for _ in range(6)]
        ma = [-arma.stationary(rng.normal(size=q)) for _ in range(6)]
        w = rng.normal(size=(6, n))
        want = [arma.likelihood(w[k], ar[k], ma[k])[0] for k in range(6)]
        assert np.allclose(arma.likelihoods(w, ar, ma), want, rtol=1e-9)
    bad = arma.likelihoods(rng.normal(size=(2, 50)), [np.array([1.2]), np.array([0.5])], [np.zeros(0), np.zeros(0)])
    assert np.isinf(bad[0]) and np.isfinite(bad[1])


def test_long_seasonal_orders_and_a_fixed_constant():
    assert ArimaOptions((0, 0, 0), (11, 3, 0), 4).seasonal == (11, 3, 0)
    y = np.cumsum(simulate([0.6], [], 300, 7)) + np.arange(300)
    for constant in (True, False):
        assert arma.auto_arima(y, AutoArimaOptions(max_p=2, max_q=2, constant=constant)).options.constant is constant


SHAPES = [(1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (2, 1, 0, 0, 0), (1, 3, 0, 0, 0), (0, 1, 0, 1, 12), (1, 1, 1, 1, 4), (2, 0, 1, 0, 5)]


@pytest.mark.parametrize("n", [4, 40, 600])
@pytest.mark.parametrize("p,q,sp,sq,period", SHAPES)
def test_the_likelihood_without_a_filter_and_its_slopes(n, p, q, sp, sq, period):
    rng = np.random.default_rng(n + p + 10 * q)
    w = rng.normal(size=n)
    ar = arma.combined(arma.stationary(rng.normal(size=p)), arma.stationary(rng.normal(size=sp)), period, -1.0)
    ma = arma.combined(-arma.stationary(rng.normal(size=q)), -arma.stationary(rng.normal(size=sq)), period, 1.0)
    value, by_ar, by_ma, by_errors = arma.exact(w, ar, ma, True)
    assert value == arma.exact(w, ar, ma) == pytest.approx(arma.likelihood(w, ar, ma)[0], rel=1e-9, abs=1e-8)
    near = lambda f, x: optimise._gradient(f, x) if len(x) else x
    assert np.allclose(by_ar, near(lambda x: arma.exact(w, x, ma), ar), rtol=1e-4, atol=1e-4)
    assert np.allclose(by_ma, near(lambda x: arma.exact(w, ar, x), ma), rtol=1e-4, atol=1e-4)
    change = rng.normal(size=n)
    moved = near(lambda x: arma.exact(w + x[0] * change, ar, ma), np.zeros(1))[0]
    assert by_errors @ np.convolve(change, np.concatenate([[1.0], -ar]))[:n] == pytest.approx(moved, rel=1e-4, abs=1e-4)


def test_no_likelihood_of_an_explosive_process():
    assert arma.exact(np.ones(50), np.array([1.2]), np.zeros(0)) == np.inf
    assert arma.exact(np.zeros(50), np.array([0.5]), np.zeros(0)) == np.inf


@pytest.mark.parametrize("p,q,sp,sq,period", SHAPES)
def test_slopes_of_the_parameter_maps(p, q, sp, sq, period):
    shape = arma._Shape(ArimaOptions((p, 0, q), (sp, 0, sq), period), 0)
    x = np.random.default_rng(p + q).normal(size=p + q + sp + sq)
    for which, slopes in enumerate(shape.slopes(x)):
        own = [k for k, block in enumerate([0] * (p + sp) + [1] * (q + sq)) if block == which]
        step = lambda k: 1e-6 * np.eye(len(x))[k]
        of = lambda v: shape.polynomials(*shape.natural(v)[1:])[which]
        want = [(of(x + step(k)) - of(x - step(k))) / 2e-6 for k in own]
        assert len(slopes) == len(own) and np.allclose(slopes, np.array(want).reshape(slopes.shape), atol=1e-7)


def test_likelihood_fits_are_at_an_optimum():
    rng = np.random.default_rng(8)
    y = simulate([0.5, -0.2], [0.4], 300)
    x = rng.normal(size=(300, 1))
    for exog, order in ((None, (2, 0, 1)), (None, (1, 1, 2)), (x, (1, 0, 1))):
        fit = arma.fit_arima(y if exog is None else y + 2 * exog[:, 0], ArimaOptions(order, method="mle"), exog)
        w = np.diff(y, n=order[1]) if exog is None else y + 2 * x[:, 0] - fit.intercept - x @ fit.beta
        w = w - w.mean() if exog is None else w
        best = arma.likelihood(w, fit.phi, fit.theta)[0]
        for k in range(order[0]):
            for h in (1e-3, -1e-3):
                assert arma.likelihood(w, fit.phi + h * np.eye(order[0])[k], fit.theta)[0] > best
        for k in range(order[2]):
            for h in (1e-3, -1e-3):
                assert arma.likelihood(w, fit.phi, fit.theta + h * np.eye(order[2])[k])[0] > best
        if exog is not None:
            for h in (1e-3, -1e-3):
                assert arma.likelihood(w - h, fit.phi, fit.theta)[0] > best and arma.likelihood(w - h * x[:, 0], fit.phi, fit.theta)[0] > best
