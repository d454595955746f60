import numpy as np
import pytest

from seriesmill import errors
from seriesmill.kernels import panel

from .generators import arma


def plain(y):
    """Features by their definitions, one value after another."""
    n = len(y)
    x = (y - y.mean()) / y.std(ddof=1)
    out = {}
    acf = np.array([((x - x.mean())[k:] * (x - x.mean())[: n - k]).sum() for k in range(n)])
    acf /= acf[0]
    out["acf_first_min"] = next((k for k in range(1, n - 1) if acf[k] < acf[k - 1] and acf[k] < acf[k + 1]), n)
    out["trev"] = np.mean([(x[t + 1] - x[t]) ** 3 for t in range(n - 1)])
    out["high_fluctuation"] = np.mean([abs(x[t + 1] - x[t]) > 0.04 for t in range(n - 1)])
    longest = last = 0
    for t in range(n - 1):
        if not x[t] > x.mean() or t == n - 2:
            longest, last = max(longest, t - last), t
    out["stretch_high"] = longest
    longest = last = 0
    for t in range(n - 1):
        if not x[t + 1] < x[t] or t == n - 2:
            longest, last = max(longest, t - last), t
    out["stretch_decreasing"] = longest
    out["forecast_error"] = np.std([x[t + 3] - x[t : t + 3].mean() for t in range(n - 3)], ddof=1)
    for sign, name in ((1, "outlier_timing_pos"), (-1, "outlier_timing_neg")):
        w = sign * x
        total, rows = (w >= 0).sum(), []
        for j in range(int(w.max() / 0.01) + 1):
            at = np.flatnonzero(w >= j * 0.01) + 1
            gaps = np.diff(at)
            rows.append((gaps.mean() if len(gaps) else np.nan if len(at) else 0, (len(at) - 1) * 100 / total, np.median(at) / (n / 2) - 1 if len(at) else 0))
        dense = max((j for j, r in enumerate(rows) if r[1] > 2), default=0)
        lone = min((j for j, r in enumerate(rows) if np.isnan(r[0])), default=len(rows) - 1)
        out[name] = np.median([r[2] for r in rows[: min(dense, lone) + 1]])
    return out


@pytest.mark.parametrize("seed,n", [(0, 30), (1, 200), (2, 501), (3, 3000)])
def test_definitions(seed, n):
    y = arma([0.6], [0.2], n, seed)
    got = dict(zip(panel.SHORT_NAMES, panel.features(y)))
    for name, want in plain(y).items():
        assert got[name] == pytest.approx(want, abs=1e-9), name
    assert got["mean"] == pytest.approx(y.mean()) and got["SD"] == pytest.approx(y.std(ddof=1))
    assert np.isfinite(list(got.values())).all()


def test_outlier_timing_while_the_set_shrinks():
    y = np.exp(np.random.default_rng(3).normal(size=400))
    got = dict(zip(panel.SHORT_NAMES, panel.features(y)))
    want = plain(y)
    assert got["outlier_timing_pos"] == pytest.approx(want["outlier_timing_pos"], abs=1e-9)
    assert got["outlier_timing_neg"] == pytest.approx(want["outlier_timing_neg"], abs=1e-9)


def test_scale_and_level_do_not_matter():
    y = arma([0.5], [], 300)
    assert np.allclose(panel.features(y)[:22], panel.features(100 + 7 * y)[:22], rtol=1e-6, atol=1e-8)


def test_constant_short_and_missing():
    flat = panel.features(np.full(50, 4.2))
    assert [k for k in range(22) if not np.isnan(flat[k])] == [2, 3, 9] and flat[22] == pytest.approx(4.2) and flat[23] == 0
    assert np.isnan(panel.features(np.array([1.0]))[23])
    assert len(panel.features(np.array([1.0, 2, 3, 4]))) == 24
    with pytest.raises(errors.NonFinite):
        panel.features(np.array([1.0, np.nan]))


def test_autocorrelation():
    y = arma([0.8], [], 100)
    a = panel.autocorrelation(y)
    c = y - y.mean()
    assert a[0] == 1 and a[5] == pytest.approx((c[5:] @ c[:-5]) / (c @ c))
    assert panel.first_zero(np.array([1, 0.5, -0.1])) == 2 and panel.first_zero(np.array([1, 0.5])) == 2
    assert panel.autocorrelation(np.ones(4)).tolist() == [0, 0, 0, 0]


def test_periodicity_of_a_sine():
    y = np.sin(2 * np.pi * np.arange(400) / 25) + 0.05 * np.random.default_rng(0).normal(size=400)
    assert abs(panel.feature(y, "periodicity") + 1 - 25) <= 1
    assert panel.feature(y, "PD_PeriodicityWang_th0_01") == panel.feature(y, "periodicity")


def test_the_panel_of_many_series_is_that_of_each():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40, 300):
        rows = [rng.normal(size=n), np.cumsum(rng.normal(size=n)), np.full(n, 3.0), np.exp(rng.normal(size=n))]
        got = panel.features_rows(rows)
        assert got.shape == (4, 24) and np.allclose(got, [panel.features(y) for y in rows], equal_nan=True)


@pytest.mark.parametrize("n", [60, 700, 6000])
def test_outlier_timing_by_each_threshold(n):
    y = np.random.default_rng(n).normal(size=n)
    x = (y - y.mean()) / y.std(ddof=1)
    for sign in (1, -1):
        z, medians = sign * x, []
        all_above = (z >= 0).sum()
        steps = [np.flatnonzero(z >= 0.01 * j) for j in range(int(z.max() / 0.01) + 1)]
        dense = [j for j, a in enumerate(steps) if (len(a) - 1) * (100 / all_above) > 2]
        lone = [j for j, a in enumerate(steps) if len(a) == 1]
        for a in steps[: min(dense[-1], lone[0] if lone else len(steps) - 1) + 1]:
            medians.append((np.median(a) + 1) / (n / 2) - 1)
        assert panel.outlier_timing(panel.Standard(x), sign) == pytest.approx(np.median(medians), abs=1e-12)
