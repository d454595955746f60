import numpy as np
import pytest

from seriesmill import errors
from seriesmill.kernels import boxcox, holt, loess, stl
from seriesmill.kernels.numbers import chi2_tail, golden_minimum, interpolate, normal_quantile
from seriesmill.params import DecomposeOptions, HoltWintersOptions, LoessOptions, StlOptions

from .generators import seasonal


def naive_loess(y, x, k, degree, robust=None):
    n = len(y)
    low = int(min(max(np.floor(min(max(x, 0), n - 1) - k // 2), 0), n - k))
    at = np.arange(low, low + k)
    reach = max(x - low, low + k - 1 - x, 1) + 1
    w = np.clip(1 - (np.abs(at - x) / reach) ** 3, 0, None) ** 3
    if robust is not None:
        w = w * robust[at]
    basis = np.vander(at - x, degree + 1, increasing=True)
    root = np.sqrt(w)
    return np.linalg.lstsq(basis * root[:, None], y[at] * root, rcond=None)[0][0]


@pytest.mark.parametrize("degree", [0, 1, 2])
@pytest.mark.parametrize("n,k", [(30, 7), (30, 8), (9, 9), (400, 120), (6, 4)])
def test_loess_equals_least_squares_at_every_point(n, k, degree):
    y = np.random.default_rng(n + k).normal(size=n)
    want = [naive_loess(y, i, k, degree) for i in range(-1, n + 1)]
    assert np.allclose(loess.fit(y[None], k, degree, None, 1, 1)[0], want, atol=1e-9)
    points = np.array([-3.0, 0.4, n / 2, n - 1.5, n + 2.0])
    assert np.allclose(loess.at_points(y, points, k, degree), [naive_loess(y, x, k, degree) for x in points], atol=1e-9)


def test_robust_weights_enter_the_fit():
    rng = np.random.default_rng(0)
    y, w = rng.normal(size=80), rng.random(80)
    want = [naive_loess(y, i, 21, 1, w) for i in range(80)]
    assert np.allclose(loess.fit(y[None], 21, 1, w[None])[0], want, atol=1e-9)


@pytest.mark.parametrize("degree,f", [(1, lambda t: 3 - 0.5 * t), (2, lambda t: 1 + t - 0.1 * t * t)])
def test_polynomials_are_recovered_beyond_the_ends(degree, f):
    t = np.arange(50.0)
    assert np.allclose(loess.fit(f(t)[None], 15, degree)[0], f(t), atol=1e-8)
    x = np.array([-4.0, 10.3, 55.0])
    assert np.allclose(loess.at_points(f(t), x, 15, degree), f(x), atol=1e-7)


def test_jumps_are_exact_at_their_points():
    y = np.random.default_rng(1).normal(size=(1, 53))
    full, jumped = loess.fit(y, 11, 1), loess.jumped(y, 11, 1, 5)
    assert np.allclose(jumped[0, [*range(0, 53, 5), 52]], full[0, [*range(0, 53, 5), 52]])
    assert np.allclose(jumped[0, 1], full[0, 0] + (full[0, 5] - full[0, 0]) / 5)


@pytest.mark.parametrize("degree", [0, 1, 2])
@pytest.mark.parametrize("weighted", [False, True])
def test_places_are_fitted_as_in_the_whole(degree, weighted):
    rng = np.random.default_rng(9)
    y = rng.normal(size=(3, 90))
    w = rng.random((3, 90)) if weighted else None
    x = np.array([-2, 0, 7, 44, 88, 89, 91])
    assert np.allclose(loess.fit_places(y, x, 17, degree, w), loess.fit(y, 17, degree, w, 2, 2)[:, x + 2], atol=1e-9)


def test_rows_are_smoothed_alone():
    y = np.random.default_rng(2).normal(size=(5, 700))
    assert np.allclose(loess.fit(y, 200, 1), np.vstack([loess.fit(r[None], 200, 1) for r in y]), atol=1e-12)


@pytest.mark.parametrize("options", [{}, {"outer": 3}, {"seasonal": "periodic"}, {"seasonal_jump": 2, "trend_jump": 4, "low_pass_jump": 3}, {"mode": "multiplicative"}, {"trend": 21, "inner": 3}])
def test_stl_parts_make_up_the_series(options):
    y = seasonal(150, 12) + 20
    t, s, r = (x[0] for x in stl.stl_rows([y], StlOptions(12, **options)))
    assert np.allclose(t * s * r if "mode" in options else t + s + r, y, atol=1e-9)


def test_stl_of_a_pure_pattern():
    pattern = np.tile([1.0, -2, 3, -2], 20)
    t, s, r = (x[0] for x in stl.stl_rows([5 + pattern], StlOptions(4, "periodic")))
    assert np.allclose(s, pattern, atol=1e-8) and np.allclose(t, 5, atol=1e-8) and np.abs(r).max() < 1e-8


def test_stl_filled_values_have_no_residual_and_outliers_no_weight():
    y = seasonal(120, 12, noise=0.1)
    gaps = y.copy()
    gaps[[0, 30, 31]] = np.nan
    t, s, r = (x[0] for x in stl.stl_rows([gaps], StlOptions(12, missing="interpolate")))
    assert np.isnan(r[[0, 30, 31]]).all() and np.isnan(r).sum() == 3 and np.isfinite(t + s).all()
    spike = y.copy()
    spike[60] += 50
    plain, robust = (stl.stl_rows([spike], StlOptions(12, outer=o))[0][0] for o in (0, 5))
    clean = stl.stl_rows([y], StlOptions(12))[0][0]
    assert np.abs(robust - clean).max() < 0.2 * np.abs(plain - clean).max()


def test_windows():
    assert StlOptions(12).trend_window == 23 and StlOptions(12, "periodic").trend_window == 19
    assert StlOptions(24).low_pass_window == 25 and StlOptions(7).low_pass_window == 7


@pytest.mark.parametrize(
    "make,error",
    [
        (lambda: LoessOptions(0), errors.InvalidSpan), (lambda: LoessOptions(1.1), errors.InvalidSpan), (lambda: LoessOptions(0.5, 3), errors.InvalidDegree),
        (lambda: StlOptions(1), errors.InvalidPeriod), (lambda: StlOptions(12, 8), errors.InvalidWindow), (lambda: StlOptions(12, 5), errors.InvalidWindow),
        (lambda: StlOptions(12, trend=10), errors.InvalidWindow), (lambda: StlOptions(12, inner=0), errors.InvalidIterations),
        (lambda: StlOptions(12, trend_jump=0), errors.InvalidJump), (lambda: StlOptions(12, mode="x"), errors.OptionError),
        (lambda: DecomposeOptions(1), errors.InvalidPeriod), (lambda: DecomposeOptions(4, missing="x"), errors.OptionError),
        (lambda: HoltWintersOptions(1.5), errors.InvalidSmoothing), (lambda: HoltWintersOptions(0.5, -0.1), errors.InvalidSmoothing),
    ],
)
def test_bad_options(make, error):
    with pytest.raises(error):
        make()


@pytest.mark.parametrize(
    "y,options,error",
    [
        ([], {}, errors.EmptySeries), ([1.0] * 23, {}, errors.SeriesTooShort), ([1.0] * 23 + [np.nan], {}, errors.NonFinite),
        ([np.nan] * 30, {"missing": "interpolate"}, errors.NonFinite), ([0.0] * 30, {"mode": "multiplicative"}, errors.NonPositive),
    ],
)
def test_stl_data_errors(y, options, error):
    with pytest.raises(error):
        stl.stl_rows([np.array(y)], StlOptions(12, **options))


def test_exponential_smoothing_by_hand():
    y = np.array([[3.0, 5, 4, 8]])
    got = holt.run(y, HoltWintersOptions(0.5))
    assert got["fitted"][0].tolist() == [3, 3, 4, 4] and got["level"][0] == 6
    y = np.array([2.0, 3, 7, 4])
    level, trend, told = 2.0, 1.0, []
    for v in y:
        told.append(level + trend)
        new = 0.7 * v + 0.3 * (level + trend)
        level, trend = new, 0.4 * (new - level) + 0.6 * trend
    line = holt.run(y[None], HoltWintersOptions(0.7, 0.4))
    assert np.allclose(line["fitted"][0], told) and line["trend"][0] == pytest.approx(trend)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_holt_winters_recovers_a_cycle(mode):
    y = np.tile([10.0, 20.0], 4)
    o = HoltWintersOptions(0.5, 0.3, 0.4, 2, mode)
    got = holt.run(y[None], o)
    assert np.allclose(got["fitted"][0], y) and got["next_phase"][0] == 0


def test_holt_winters_errors():
    o = HoltWintersOptions(0.5, 0.1, 0.1, 4, "multiplicative")
    for y, error in (([1.0] * 7, errors.SeriesTooShort), ([1.0] * 7 + [-1], errors.NonPositive), ([np.inf] * 8, errors.NonFinite)):
        with pytest.raises(error):
            holt.check(np.array(y), o)
    assert holt.check(np.array([]), o) == {}


def test_box_cox_searches():
    rng = np.random.default_rng(0)
    logs = np.exp(rng.normal(size=2000))
    assert abs(boxcox.by_likelihood(logs)) < 0.08 and abs(boxcox.by_correlation(logs)) < 0.08
    squares = np.abs(rng.normal(10, 2.5, 2000)) ** 2
    assert boxcox.by_likelihood(squares) == pytest.approx(0.5, abs=0.2)
    level = np.repeat(np.linspace(10, 100, 30), 12)
    wave = 1 + 0.2 * np.sin(2 * np.pi * np.arange(360) / 12)
    assert boxcox.by_blocks(level * wave, 12) < 0.5
    assert boxcox.by_blocks(level + 5 * (wave - 1), 12) == pytest.approx(1, abs=0.1)


@pytest.mark.parametrize("y,how,error", [([1.0, -1], "mle", errors.NonPositive), ([1.0], "mle", errors.TooFewObservations), ([1.0, 2, 3], "pearsonr", errors.TooFewObservations), ([1.0] * 30, ("guerrero", 1), errors.InvalidPeriod), ([1.0] * 11, ("guerrero", 6), errors.TooFewObservations)])
def test_box_cox_errors(y, how, error):
    with pytest.raises(error):
        boxcox.choose(np.array(y), how)


def test_numbers():
    assert np.allclose(normal_quantile(np.array([0.025, 0.5, 0.975, 0.001])), [-1.959963985, 0, 1.959963985, -3.090232306], atol=2e-8)
    assert chi2_tail(18.307, 10) == pytest.approx(0.05, abs=2e-3) and chi2_tail(0, 3) == 1
    assert golden_minimum(lambda x: (x - 0.7) ** 2, -2, 2) == pytest.approx(0.7, abs=1e-6)
    assert interpolate(np.array([np.nan, 1, np.nan, 3, np.inf])).tolist() == [1, 1, 2, 3, 3]
