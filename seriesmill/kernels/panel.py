"""The canonical panel of 22 (24) features of a series.

Each feature is a function of a ``Standard`` object, which holds the standardised series
and what several features share (its autocorrelation, quantile labels, spectrum).
"""

from __future__ import annotations

import math
from functools import cached_property, lru_cache

import numpy as np

from ..errors import NonFinite

# The features' names in panel order, and their short names.
NAMES = (
    "DN_HistogramMode_5", "DN_HistogramMode_10", "CO_f1ecac", "CO_FirstMin_ac", "CO_HistogramAMI_even_2_5", "CO_trev_1_num",
    "MD_hrv_classic_pnn40", "SB_BinaryStats_mean_longstretch1", "SB_TransitionMatrix_3ac_sumdiagcov", "PD_PeriodicityWang_th0_01",
    "CO_Embed2_Dist_tau_d_expfit_meandiff", "IN_AutoMutualInfoStats_40_gaussian_fmmi", "FC_LocalSimple_mean1_tauresrat",
    "DN_OutlierInclude_p_001_mdrmd", "DN_OutlierInclude_n_001_mdrmd", "SP_Summaries_welch_rect_area_5_1",
    "SB_BinaryStats_diff_longstretch0", "SB_MotifThree_quantile_hh", "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1",
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1", "SP_Summaries_welch_rect_centroid", "FC_LocalSimple_mean3_stderr", "DN_Mean", "DN_Spread_Std",
)
SHORT_NAMES = (
    "mode_5", "mode_10", "acf_timescale", "acf_first_min", "ami2", "trev", "high_fluctuation", "stretch_high", "transition_matrix",
    "periodicity", "embedding_dist", "ami_timescale", "whiten_timescale", "outlier_timing_pos", "outlier_timing_neg", "centroid_freq",
    "stretch_decreasing", "entropy_pairs", "rs_range", "dfa", "low_freq_power", "forecast_error", "mean", "SD",
)


def autocovariance(x: np.ndarray) -> np.ndarray:
    """Sums of lagged products of centred values, by FFT."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(), size)
    return np.fft.irfft(f * np.conj(f), size)[:n]


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Biased, 1 at lag 0; zeros for a constant series."""
    if len(x) < 2:
        return np.ones(max(len(x), 1))
    c = autocovariance(x)
    return c / c[0] if c[0] > 0 else np.zeros(len(x))


def _first(flags: np.ndarray, otherwise):
    at = np.flatnonzero(flags)
    return at[0] if len(at) else otherwise


def first_zero(acf: np.ndarray) -> int:
    return int(_first(acf[1:] <= 0, len(acf) - 1)) + 1 if len(acf) >= 2 else len(acf)


def thirds(x: np.ndarray) -> np.ndarray:
    """Labels 0, 1, 2 by the series' terciles (each upper end belongs to its group)."""
    n, s = len(x), np.sort(x)
    cuts = []
    for q in (1 / 3, 2 / 3):
        if q < 0.5 / n:
            cuts.append(s[0])
        elif q > 1 - 0.5 / n:
            cuts.append(s[-1])
        else:
            at = n * q - 0.5
            low, high = math.floor(at), math.ceil(at)
            cuts.append(s[low] + (at - low) * (s[high] - s[low]))
    return np.searchsorted(np.array(cuts), x, "left")


class Standard:
    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    @cached_property
    def acf(self) -> np.ndarray:
        return autocorrelation(self.x)

    @cached_property
    def zero(self) -> int:
        return first_zero(self.acf)

    @cached_property
    def spectrum(self):
        """One-sided power by angular frequency, of one rectangular window."""
        size = max(1 << (self.n - 1).bit_length(), 2)
        power = np.abs(np.fft.rfft(self.x - self.x.mean(), size)) ** 2 / self.n
        power[1:-1] *= 2
        return power / (2 * np.pi), 2 * np.pi * np.arange(len(power)) / size, size


def histogram_mode(s: Standard, bins: int) -> float:
    low, high = s.x.min(), s.x.max()
    if high == low:
        return 0.0
    width = (high - low) / bins
    count = np.bincount(np.clip(((s.x - low) / width).astype(int), 0, bins - 1), minlength=bins)
    centres = low + width * (np.arange(bins) + 0.5)
    return float(centres[count == count.max()].mean())


def decorrelation_time(s: Standard) -> float:
    if s.n < 3:
        return math.nan
    level = 1 / math.e
    k = _first((s.acf[:-1] >= level) & (s.acf[1:] < level), None)
    return float(s.n) if k is None else float(k + (s.acf[k] - level) / (s.acf[k] - s.acf[k + 1]))


def first_minimum(s: Standard) -> float:
    if s.n < 3:
        return math.nan
    a = s.acf
    k = _first((a[1:-1] < a[:-2]) & (a[1:-1] < a[2:]), None)
    return float(s.n if k is None else k + 1)


def histogram_information(s: Standard, lag: int = 2, bins: int = 5) -> float:
    if s.n <= lag + 1:
        return math.nan
    low, high = s.x.min() - 0.1, s.x.max() + 0.1
    if high - low == 0.2:
        return 0.0
    cell = np.clip(np.floor((s.x - low) / ((high - low) / bins)).astype(int), 0, bins - 1)
    joint = np.bincount(cell[:-lag] * bins + cell[lag:], minlength=bins * bins).reshape(bins, bins) / (s.n - lag)
    alone = np.outer(joint.sum(axis=1), joint.sum(axis=0))
    on = joint > 0
    return float((joint[on] * np.log(joint[on] / alone[on])).sum())


def time_reversal(s: Standard) -> float:
    if s.n < 2:
        return math.nan
    step = np.diff(s.x)
    return float((step * step * step).mean())


def large_steps(s: Standard) -> float:
    return float((np.abs(np.diff(s.x)) * 1000 > 40).mean()) if s.n >= 2 else math.nan


def _stretch(stops: np.ndarray) -> float:
    """The largest gap between stops, with the start and the last place as stops."""
    at = np.concatenate([[0], np.flatnonzero(stops), [len(stops) - 1]])
    return float(max(np.diff(at).max(), 0))


def stretch_above_mean(s: Standard) -> float:
    return _stretch(~(s.x[:-1] > s.x.mean())) if s.n >= 2 else math.nan


def stretch_of_falls(s: Standard) -> float:
    return _stretch(~(np.diff(s.x) < 0)) if s.n >= 2 else math.nan


def transition_spread(s: Standard) -> float:
    if s.n < 3 or not 0 < s.zero < s.n:
        return math.nan
    label = thirds(s.x[:: s.zero])
    if len(label) < 2:
        return math.nan
    moves = np.bincount(label[:-1] * 3 + label[1:], minlength=9).reshape(3, 3) / (len(label) - 1)
    return float(moves.var(axis=0, ddof=1).sum())


@lru_cache(maxsize=16)
def _spline_basis(n: int) -> np.ndarray:
    """Orthonormal columns that span the cubic splines with one knot in the middle."""
    t = np.arange(n) / (n - 1)
    knot = (n // 2 - 1) / (n - 1)
    return np.linalg.qr(np.stack([np.ones(n), t, t**2, t**3, np.clip(t - knot, 0, None) ** 3], axis=1))[0]


def _without_spline(x: np.ndarray) -> np.ndarray:
    """Residuals of the least-squares spline."""
    basis = _spline_basis(len(x))
    return x - basis @ (x @ basis)


def periodicity(s: Standard, least: float = 0.01) -> float:
    n = s.n
    lags = math.ceil(n / 3)
    if n < 5 or lags < 3:
        return 0.0
    rest = _without_spline(s.x)
    tau = np.arange(1, lags + 1)
    a = np.where(tau < n, autocovariance(rest)[np.minimum(tau, n - 1)] / np.maximum(n - tau, 1), 0.0)
    rise = np.diff(a)
    peaks = np.flatnonzero((rise[:-1] > 0) & (rise[1:] < 0)) + 1
    troughs = np.flatnonzero((rise[:-1] < 0) & (rise[1:] > 0)) + 1
    before = np.searchsorted(troughs, peaks) - 1
    ok = before >= 0
    peaks, before = peaks[ok], before[ok]
    fits = (a[peaks] - a[troughs[before]] >= least) & (a[peaks] >= 0) if len(peaks) else np.zeros(0, bool)
    return float(peaks[fits][0]) if fits.any() else 0.0


def embedding_distances(s: Standard) -> float:
    lag = s.zero if s.zero <= s.n / 10 else s.n // 10
    if s.n < 4 or lag == 0 or s.n - lag - 1 < 2:
        return math.nan
    step = np.diff(s.x)
    m = s.n - lag - 1
    d = np.hypot(step[:m], step[lag : lag + m])
    sd = d.std(ddof=1)
    if not sd >= 0.001:
        return 0.0
    bins = math.ceil((d.max() - d.min()) / (3.5 * sd / m ** (1 / 3)))
    if bins == 0:
        return 0.0
    width = (d.max() - d.min()) / bins
    count = np.bincount(np.clip(((d - d.min()) / width).astype(int), 0, bins - 1), minlength=bins)
    centre = d.min() + width * (np.arange(bins) + 0.5)
    rate = d.mean()
    return float(np.abs(count / m - np.exp(-centre / rate) / rate).mean())


def gaussian_information_minimum(s: Standard, most: int = 40) -> float:
    """From all lags' correlations at once: sums over the ends come from running totals."""
    n, x = s.n, s.x
    if n < 4:
        return math.nan
    lags = min(most, math.ceil(n / 2))
    k = np.arange(1, lags + 1)
    if n * lags < 200_000:
        cross = np.correlate(x, x, "full")[n : n + lags]
    else:
        cross = np.array([x[:-lag] @ x[lag:] for lag in k])
    total, square = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
    m = n - k
    head, tail = total[m], total[n] - total[k]
    spread = (square[m] - head * head / m) * (square[n] - square[k] - tail * tail / m)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = (cross - head * tail / m) ** 2 / spread
        out = np.where(r2 < 1, -0.5 * np.log1p(-np.minimum(r2, 1)), np.where(r2 >= 1, np.inf, np.nan))
    found = _first((out[1:-1] < out[:-2]) & (out[1:-1] < out[2:]), None)
    return float(lags if found is None else found + 1)


def whitening(s: Standard) -> float:
    if s.n < 4 or s.zero == 0:
        return math.nan
    return first_zero(autocorrelation(np.diff(s.x))) / s.zero


def _ranked(at: np.ndarray, leaves: np.ndarray, alive: np.ndarray, ranks: list[np.ndarray]) -> list[np.ndarray]:
    """For each threshold j, the places of the given ranks (from 1) among the ``at`` that
    leave after j: counts by block of places find the block, counts in it the place."""
    count = len(alive)
    width = max(16, int(math.sqrt(len(at))))
    blocks = -(-len(at) // width)
    block = np.arange(len(at)) // width
    left = np.bincount(np.minimum(leaves, count) * blocks + block, minlength=(count + 1) * blocks).reshape(count + 1, blocks)
    here = np.cumsum(left[::-1], axis=0)[::-1][1:]  # alive at j: leaves > j
    upto = np.cumsum(here, axis=1)
    places = np.zeros(blocks * width)
    places[: len(at)] = at
    padded = np.zeros(blocks * width, leaves.dtype)  # what pads leaves at once
    padded[: len(at)] = leaves
    padded = padded.reshape(blocks, width)
    j = np.arange(count)
    out = []
    for rank in ranks:
        b = (upto >= rank[:, None]).argmax(axis=1)
        inner = rank - (upto[j, b] - here[j, b])
        seen = np.cumsum(padded[b] > j[:, None], axis=1, dtype=np.int32)
        out.append(places[b * width + (seen >= inner[:, None]).argmax(axis=1)])
    return out


def outlier_timing(s: Standard, sign: int, step: float = 0.01) -> float:
    """Median over rising thresholds of how far off centre the values above are."""
    n = s.n
    if n < 4:
        return math.nan
    y = sign * s.x
    if s.x.min() == s.x.max() or y.max() < step:
        return 0.0
    count = int(y.max() / step) + 1
    at = np.flatnonzero(y >= 0)
    leaves = np.searchsorted(np.arange(count + 1) * step, y[at], "right")  # the first threshold above
    left = np.bincount(np.minimum(leaves, count), minlength=count + 1)
    alive = len(at) - np.cumsum(left)[:count]
    dense = np.flatnonzero((alive - 1) * (100.0 / len(at)) > 2.0)
    lone = np.flatnonzero(alive == 1)
    last = min(dense[-1] if len(dense) else 0, lone[0] if len(lone) else count - 1)
    alive = alive[: last + 1]
    changes = np.flatnonzero(np.diff(alive, prepend=-1))  # between these nothing leaves
    runs = np.diff(changes, append=len(alive))
    alive, leaves = alive[changes], np.searchsorted(changes, leaves, "left")
    one, two = _ranked(at, leaves, alive, [np.maximum((alive + 1) // 2, 1), np.maximum(alive // 2 + 1, 1)])
    centre = np.where(alive > 0, ((one + two) / 2 + 1) / (n / 2) - 1, 0.0)
    return float(np.median(np.repeat(centre, runs)))


def low_frequency_area(s: Standard) -> float:
    if s.n < 4:
        return math.nan
    power, _, size = s.spectrum
    return float(power[: len(power) // 5].sum() * 2 * np.pi / (1 << (s.n - 1).bit_length()))


def spectral_centroid(s: Standard) -> float:
    if s.n < 4:
        return math.nan
    power, omega, _ = s.spectrum
    total = np.cumsum(power)
    k = _first(total > total[-1] * 0.5, None)
    return 0.0 if k is None else float(omega[k])


def pair_entropy(s: Standard) -> float:
    if s.n < 3:
        return math.nan
    label = thirds(s.x)
    p = np.bincount(label[:-1] * 3 + label[1:], minlength=9) / (s.n - 1)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


@lru_cache(maxsize=16)
def _scales(n: int, least: int = 6):
    """Window lengths for a series of n, their logarithms, the splits of these into two
    lines that share a point, and for both sides of all splits, as rows of a mask, the
    sums that the lines need. None if there are too few."""
    low, high = math.log(5), math.log(n // 2)
    tau = np.unique(np.floor(np.exp(low + np.arange(50) * (high - low) / 49) + 0.5).astype(int))
    if len(tau) < 12:
        return None
    x, place = np.log(tau), np.arange(len(tau))
    split = np.arange(least, len(tau) - least + 1)
    sides = []
    for mask in (place[None, :] < split[:, None], place[None, :] >= split[:, None] - 1):
        m, sx, sxx = (v[:, None] for v in (mask.sum(axis=1), mask @ x, mask @ (x * x)))
        sides.append((mask, m, sx, sxx, m * sxx - sx * sx))
    return tau, x, split, sides


def _two_lines(x: np.ndarray, y: np.ndarray, split: np.ndarray, sides) -> np.ndarray:
    """The number of points of the first of two lines, where they fit each row of y best."""
    total = np.zeros((len(split), len(y)))
    for mask, m, sx, sxx, det in sides:
        sy, sxy = mask @ y.T, mask @ (x * y).T
        slope = np.where(det != 0, (m * sxy - sx * sy) / det, 0.0)
        level = np.where(det != 0, (sy * sxx - sx * sxy) / det, 0.0)
        rest = np.where(mask[:, None, :], slope[:, :, None] * x + level[:, :, None] - y, 0.0)
        total += np.sqrt(np.einsum("ijk,ijk->ij", rest, rest))
    best = np.where(np.isnan(total), math.inf, total).min(axis=0)
    return np.where(best < math.inf, split[(total == best).argmax(axis=0)], 0)


def _line_basis(t: int) -> np.ndarray:
    """Orthonormal columns that span the straight lines over t points."""
    return _small_basis(t) if t <= 2048 else _small_basis.__wrapped__(t)


@lru_cache(maxsize=512)
def _small_basis(t: int) -> np.ndarray:
    u = np.arange(t) - (t - 1) / 2
    return np.stack([np.full(t, 1 / math.sqrt(t)), u / math.sqrt(u @ u)], axis=1)


def fluctuations(x: np.ndarray, stride: int, ranges: bool) -> np.ndarray:
    """Of each row of x, all of one length: a window's residuals lie in a column."""
    count, n = x.shape
    if n < 4:
        return np.full(count, math.nan)
    if n // 2 <= 5:
        return np.zeros(count)
    scales = _scales(n)
    if scales is None or n // stride < 2:
        return np.zeros(count)
    tau, logs, *sides = scales
    path = np.cumsum(x[:, ::stride][:, : n // stride], axis=1)
    out = np.zeros((count, len(tau)))
    for k, t in enumerate(tau.tolist()):
        m = path.shape[1] // t
        if m == 0:
            continue
        cells = path[:, : m * t].reshape(count * m, t)
        basis = _line_basis(t)
        if t < 64 < count * m:  # a window a column: many short rows are slow to reduce
            rest, along = cells.T - basis @ (basis.T @ cells.T), 0
        else:
            rest, along = cells - (cells @ basis) @ basis.T, 1
        if ranges:
            reach = (np.maximum.reduce(rest, axis=along) - np.minimum.reduce(rest, axis=along)).reshape(count, m)
            squares = np.einsum("ij,ij->i", reach, reach) / m
        else:
            each = np.einsum("ij,ij->j" if along == 0 else "ij,ij->i", rest, rest)
            squares = np.add.reduce(each.reshape(count, m), axis=1) / (m * t)
        out[:, k] = squares
    out = np.sqrt(out)
    with np.errstate(divide="ignore", invalid="ignore"):
        return _two_lines(logs, np.log(out), *sides) / len(tau)


def fluctuation(s: Standard, stride: int, ranges: bool) -> float:
    return float(fluctuations(s.x[None], stride, ranges)[0])


def local_mean_error(s: Standard) -> float:
    if s.n <= 4:
        return math.nan
    return float((s.x[3:] - (s.x[:-3] + s.x[1:-2] + s.x[2:-1]) / 3).std(ddof=1))


FEATURES = (
    lambda s: histogram_mode(s, 5), lambda s: histogram_mode(s, 10), decorrelation_time, first_minimum, histogram_information, time_reversal,
    large_steps, stretch_above_mean, transition_spread, periodicity, embedding_distances, gaussian_information_minimum, whitening,
    lambda s: outlier_timing(s, 1), lambda s: outlier_timing(s, -1), low_frequency_area, stretch_of_falls, pair_entropy,
    lambda s: fluctuation(s, 1, True), lambda s: fluctuation(s, 2, False), spectral_centroid, local_mean_error,
)

_WITHOUT_SPREAD = {2: 0.0, 3: 0.0, 9: 0.0}


def check(y: np.ndarray) -> None:
    if not np.isfinite(y).all():
        raise NonFinite("the series has missing or infinite values")


def _moments(y: np.ndarray) -> tuple[float, float, bool]:
    """Mean, standard deviation, and whether the series has no spread."""
    check(y)
    n = len(y)
    mean = float(np.cumsum(y)[-1] / n) if n else math.nan
    sd = float(y.std(ddof=1)) if n >= 2 else math.nan
    flat = n < 2 or sd == 0 or y.min() == y.max()
    return mean, (0.0 if n >= 2 else sd) if flat else sd, flat


_OF_ROWS = {18: lambda x: fluctuations(x, 1, True), 19: lambda x: fluctuations(x, 2, False)}


def features_rows(rows: list[np.ndarray]) -> np.ndarray:
    """The panel of each of some series of one length, a row each; of a constant series,
    and of a single value, all but three features are NaN."""
    moments = [_moments(y) for y in rows]
    out = np.full((len(rows), 24), math.nan)
    out[:, 22:] = [m[:2] for m in moments]
    for k, value in _WITHOUT_SPREAD.items():
        out[:, k] = value
    spread = [k for k, m in enumerate(moments) if not m[2]]
    if not spread:
        return out
    x = np.stack([(rows[k] - moments[k][0]) / moments[k][1] for k in spread])
    for row, k in zip(x, spread):
        s = Standard(row)
        for j, f in enumerate(FEATURES):
            if j not in _OF_ROWS:
                out[k, j] = f(s)
    for j, f in _OF_ROWS.items():
        out[spread, j] = f(x)
    return out


def features(y: np.ndarray, extras: bool = True) -> np.ndarray:
    """The panel of one series."""
    return features_rows([y])[0][: 24 if extras else 22]


def feature(y: np.ndarray, name: str) -> float:
    """One feature by its name or short name, without the others."""
    k = NAMES.index(name) if name in NAMES else SHORT_NAMES.index(name)
    mean, sd, flat = _moments(y)
    if k >= 22:
        return (mean, sd)[k - 22]
    return _WITHOUT_SPREAD.get(k, math.nan) if flat else float(FEATURES[k](Standard((y - mean) / sd)))
