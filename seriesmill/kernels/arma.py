"""Seasonal ARMA processes: polynomials, filters, exact likelihood, estimation.

The recursions run as convolutions where they can: conditional residuals are the AR part
of the series convolved with the impulse response of the inverted MA polynomial, and the
Kalman filter steps through time only until its gain is steady; from there its
innovations obey the same kind of recursion. Estimation takes the exact likelihood without
a filter, from conditional errors and the best state before the first value, and its
derivatives in closed form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..errors import ExogMismatch, NonFinite, NotConverged, SeriesTooShort, SingularModel
from ..params import ArimaOptions, AutoArimaOptions
from .numbers import normal_quantile
from .optimise import hessian, least_squares, newton, quasi_newton, simplex
from .diagnostics import ndiffs, nsdiffs

# --- polynomials -------------------------------------------------------------------------


def difference(y: np.ndarray, d: int, seasonal_d: int, period: int) -> np.ndarray:
    for _ in range(seasonal_d):
        y = y[period:] - y[:-period]
    for _ in range(d):
        y = np.diff(y)
    return y


def difference_polynomial(d: int, seasonal_d: int, period: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^m)^D, the first being 1."""
    out = np.ones(1)
    for _ in range(d):
        out = np.convolve(out, [1.0, -1.0])
    for _ in range(seasonal_d):
        out = np.convolve(out, np.concatenate([[1.0], np.zeros(period - 1), [-1.0]]))
    return out


def _spread(c: np.ndarray, period: int) -> np.ndarray:
    out = np.zeros(len(c) * period)
    out[period - 1 :: period] = c
    return out


def combined_slopes(by_short: np.ndarray, by_long: np.ndarray, short: np.ndarray, long: np.ndarray, period: int, sign: float) -> np.ndarray:
    """The derivatives of ``combined`` from rows of those of its parts."""
    if len(long) == 0:
        return by_short
    wide, narrow = np.concatenate([[1.0], sign * _spread(long, period)]), np.concatenate([[1.0], sign * short])
    rows = [np.convolve(np.concatenate([[0.0], d]), wide)[1:] for d in by_short]
    rows += [np.convolve(np.concatenate([[0.0], _spread(d, period)]), narrow)[1:] for d in by_long]
    return np.array(rows).reshape(len(rows), len(short) + len(long) * period)


def combined(short: np.ndarray, long: np.ndarray, period: int, sign: float) -> np.ndarray:
    """Lag coefficients of the product of a short and a seasonal polynomial; ``sign`` is
    -1 for AR (1 - c B ...) and 1 for MA (1 + c B ...)."""
    if len(long) == 0:
        return short
    product = np.convolve(np.concatenate([[1.0], sign * short]), np.concatenate([[1.0], sign * _spread(long, period)]))
    return sign * product[1:]


#: Partial autocorrelations of conditional fits stay within this. Their sum of squares may
#: fall right up to a unit root and past it, and then has no minimum short of one.
CSS_LIMIT = 0.9999
#: Beyond this number a partial autocorrelation is within 5e-5 of its limit; the limit itself.
NEAR_LIMIT, AT_LIMIT = 100.0, 1e8


def stationary(real: np.ndarray, limit: float = 1.0) -> np.ndarray:
    """AR coefficients of a stationary process from any real numbers: these become
    partial autocorrelations within ``limit``, and these coefficients by Durbin and
    Levinson."""
    out: list[float] = []
    for x in real.tolist():
        r = limit * (x / math.sqrt(1 + x * x))
        out = [a - r * b for a, b in zip(out, reversed(out))]
        out.append(r)
    return np.array(out)


def stationary_slopes(real: np.ndarray, limit: float = 1.0) -> np.ndarray:
    """The derivatives of ``stationary``: a row for each number, a column a coefficient."""
    k = len(real)
    ar, out = np.zeros(0), np.zeros((k, k))
    for j, x in enumerate(real.tolist()):
        root = math.sqrt(1 + x * x)
        r = limit * (x / root)
        out[:j, :j] -= r * out[:j, :j][:, ::-1]
        out[j, :j], out[j, j] = -ar[::-1] * limit / root**3, limit / root**3
        ar = np.append(ar - r * ar[::-1], r)
    return out


def unconstrained(ar: np.ndarray, limit: float = 1.0) -> np.ndarray:
    """The inverse of ``stationary``, for coefficients near enough to stationary."""
    ar, partial = ar.copy(), []
    while len(ar):
        r = float(np.clip(ar[-1], -0.999999, 0.999999))
        partial.append(r)
        ar = (ar[:-1] + r * ar[:-1][::-1]) / (1 - r * r)
    partial = np.clip(np.array(partial[::-1]) / limit, -0.999999, 0.999999)
    return partial / np.sqrt(1 - partial * partial)


def _is_stationary(ar: np.ndarray) -> bool:
    while len(ar):
        r = ar[-1]
        if not abs(r) < 0.999:
            return False
        ar = (ar[:-1] + r * ar[:-1][::-1]) / (1 - r * r)
    return True


# --- filters -----------------------------------------------------------------------------


def impulse(ma: np.ndarray, n: int) -> np.ndarray:
    """Coefficients of 1 / (1 + ma_1 B + ...), as far as they matter."""
    lags = [(j + 1, float(c)) for j, c in enumerate(ma.tolist()) if c != 0.0]
    if not lags:
        return np.ones(1)
    reach = lags[-1][0]
    if len(lags) == 1 and reach == 1:
        c = -lags[0][1]
        size = n if abs(c) >= 0.9999 else min(n, int(40 / -math.log(abs(c))) + 2)
        return c ** np.arange(size)
    out = [0.0] * reach + [1.0]  # zeros before the start spare a test
    for t in range(reach + 1, reach + n):
        v = 0.0
        for j, c in lags:
            v -= c * out[t - j]
        out.append(v)
        if t % 64 == 0 and t > 2 * reach and max(map(abs, out[-reach:])) < 1e-17:
            break
    return np.array(out[reach:])


def _convolve(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(u)
    if len(h) == 1:
        return u * h[0]
    if len(h) * n < 400_000:
        return np.convolve(u, h)[:n]
    size = 1 << (n + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(u, size) * np.fft.rfft(h, size), size)[:n]


def residuals(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional residuals: 0 before max(len(ar), len(ma)), then the recursion."""
    start = max(len(ar), len(ma))
    u = np.convolve(w, np.concatenate([[1.0], -ar]))[start : len(w)]
    out = np.zeros(len(w))
    with np.errstate(over="ignore", invalid="ignore"):
        out[start:] = _convolve(u, impulse(ma, len(u))) if len(u) else u
    return out


class Kalman:
    """Prediction errors of a stationary ARMA process with unit innovation variance."""

    def __init__(self, ar: np.ndarray, ma: np.ndarray, n: int, tolerance: float = 1e-13):
        r = max(len(ar), len(ma) + 1)
        self.ar = np.pad(ar, (0, r - len(ar)))
        load = np.pad(np.concatenate([[1.0], ma]), (0, r - 1 - len(ma)))
        step = np.diag(np.ones(r - 1), 1)
        step[:, 0] += self.ar
        noise = np.outer(load, load)
        p, a = noise.copy(), step.copy()
        for _ in range(60):  # the stationary covariance, doubling the horizon
            add = a @ p @ a.T
            if not np.isfinite(add).all():
                raise SingularModel("the process is not stationary")
            p = p + add
            if np.abs(add).max() <= 1e-14 * np.abs(p).max():
                break
            a = a @ a
        self.f, self.gain = [], []
        for _ in range(n):
            f = p[0, 0]
            if not f > 0:
                raise SingularModel("a prediction variance is not positive")
            k = step @ p[:, 0] / f
            self.f.append(f)
            self.gain.append(k)
            new = step @ p @ step.T - np.outer(k, k) * f + noise
            if np.abs(new - p).max() < tolerance * max(1.0, np.abs(p).max()):
                break
            p = new
        self.r, self.n = r, n

    def variances(self) -> np.ndarray:
        out = np.full(self.n, self.f[-1])
        out[: len(self.f)] = self.f
        return out

    def errors(self, w: np.ndarray) -> np.ndarray:
        n, r = len(w), self.r
        steps = min(n, len(self.f) + r)
        out = np.zeros(n)
        state = np.zeros(r)
        for t in range(steps):
            k = self.gain[t] if t < len(self.gain) else self.gain[-1]
            out[t] = v = w[t] - state[0]
            first = state[0]
            state = np.append(state[1:], 0.0) + self.ar * first + k * v
        if steps < n:
            ma = self.gain[-1] - self.ar
            u = np.convolve(w, np.concatenate([[1.0], -self.ar]))[steps:n]
            tail = out[max(0, steps - r) : steps][::-1]
            for j in range(min(r, n - steps)):  # errors from before the steady stretch
                known = tail[: r - j]
                u[j] -= ma[j : j + len(known)] @ known
            out[steps:] = _convolve(u, impulse(ma, len(u)))
        return out


def likelihood(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float]:
    """(n ln s2 + sum of ln F, s2) with the variance s2 at its best; inf if there is none."""
    try:
        k = Kalman(ar, ma, len(w))
    except SingularModel:
        return math.inf, math.nan
    with np.errstate(over="ignore", invalid="ignore"):
        f, v = k.variances(), k.errors(w)
        s2 = float((v * v / f).mean())
    if not (math.isfinite(s2) and s2 > 0):
        return math.inf, math.nan
    return len(w) * math.log(s2) + float(np.log(f).sum()), s2


def _stacked(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def likelihoods(w: np.ndarray, ar: list[np.ndarray], ma: list[np.ndarray]) -> np.ndarray:
    """What ``likelihood`` gives for each row of ``w`` and its polynomials, with the filter's
    steps taken for all rows at once."""
    count, n = w.shape
    r = max(len(ar[0]), len(ma[0]) + 1)
    ar, load = _stacked(ar, r), _stacked([np.concatenate([[1.0], m]) for m in ma], r)
    step = np.zeros((count, r, r))
    step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    step[:, :, 0] += ar
    noise = load[:, :, None] * load[:, None, :]
    p, a = noise.copy(), step.copy()
    good = np.ones(count, bool)
    with np.errstate(all="ignore"):
        for _ in range(60):  # the stationary covariance, doubling the horizon
            add = a @ p @ a.transpose(0, 2, 1)
            good &= np.isfinite(add).all(axis=(1, 2))
            add[~good], a[~good] = 0.0, 0.0
            p = p + add
            if (np.abs(add).max(axis=(1, 2)) <= 1e-14 * np.abs(p).max(axis=(1, 2))).all():
                break
            a = a @ a
        fs, gains = [], []
        back = step.transpose(0, 2, 1)
        for _ in range(n):
            f = p[:, 0, 0]
            good &= f > 0
            k = (step @ p[:, :, :1])[:, :, 0] / f[:, None]
            fs.append(f)
            gains.append(k)
            new = step @ p @ back - k[:, :, None] * k[:, None, :] * f[:, None, None] + noise
            steady = np.abs(new - p).max(axis=(1, 2)) < 1e-13 * np.maximum(1.0, np.abs(p).max(axis=(1, 2)))
            if (steady | ~good).all():
                break
            p = new
        f = np.stack(fs, axis=1)
        steps = min(n, f.shape[1] + r)
        out = np.zeros((count, n))
        state = np.zeros((count, r + 1))
        for t in range(steps):
            first = state[:, :1].copy()
            out[:, t] = v = w[:, t] - first[:, 0]
            state[:, :r] = state[:, 1:] + ar * first + gains[min(t, len(gains) - 1)] * v[:, None]
        if steps < n:
            late = gains[-1] - ar
            u = w[:, steps:].copy()
            for j in range(r):
                u -= ar[:, j : j + 1] * w[:, steps - j - 1 : n - j - 1]
            tail = out[:, max(0, steps - r) : steps][:, ::-1]
            for j in range(min(r, n - steps)):  # errors from before the steady stretch
                known = tail[:, : r - j]
                u[:, j] -= (late[:, j : j + known.shape[1]] * known).sum(axis=1)
            for k in np.flatnonzero(good).tolist():
                out[k, steps:] = _convolve(u[k], impulse(late[k], n - steps))
        logs = np.log(f)
        ends = np.concatenate([out[:, : f.shape[1]] ** 2 / f, out[:, f.shape[1] :] ** 2 / f[:, -1:]], axis=1)
        s2 = ends.mean(axis=1)
        value = n * np.log(s2) + logs.sum(axis=1) + (n - f.shape[1]) * logs[:, -1]
    return np.where(good & np.isfinite(s2) & (s2 > 0), value, math.inf)


def exact(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, slopes: bool = False):
    """What ``likelihood`` gives first, without a filter: the errors are those from a start
    at zero, less the response Z a to the state a before the first value, which is normal
    with covariance Q; the sum of squares is the least over a. With ``slopes`` also the
    derivatives by the coefficients of ar and ma, and what an error's change at each place
    does to the value (the errors being linear in w, that serves regressors)."""
    n, g = len(w), max(len(ar), len(ma))
    a_, m_ = _stacked([ar, ma], g)
    h = impulse(ma, n) if len(ma) else np.ones(1)
    e = _convolve(np.convolve(w, np.concatenate([[1.0], -ar]))[:n], h)
    none = (math.inf, np.zeros(len(ar)), np.zeros(len(ma)), np.zeros(n))
    step = np.zeros((g, g))
    step[np.arange(g - 1), np.arange(1, g)] = 1.0
    if g:
        step[:, 0] += a_
    load = a_ + m_
    with np.errstate(all="ignore"):
        q = _accumulated(step, np.outer(load, load))
        if q is None:
            return none if slopes else math.inf
        z = np.zeros((min(n, len(h) + g), g))
        for j in range(min(g, len(z))):
            z[j : j + len(h), j] = h[: len(z) - j]
        gram = z.T @ z
        inner = np.eye(g) + q @ gram
        sign, logdet = np.linalg.slogdet(inner)
        try:
            pull = np.linalg.solve(inner.T, z.T @ e[: len(z)])
        except np.linalg.LinAlgError:
            return none if slopes else math.inf
        start = q @ pull
        e[: len(z)] -= z @ start
        square = float(e @ e + start @ pull)
        if not (sign > 0 and math.isfinite(square) and square > 0):
            return none if slopes else math.inf
        value = n * math.log(square / n) + float(logdet)
        if not slopes:
            return value
        back = _convolve(e[::-1], h)[::-1]
        rate = n / square
        by_ar = np.array([-2 * rate * (back[j:] @ w[: max(n - j, 0)]) for j in range(1, len(ar) + 1)])
        by_ma = np.array([-2 * rate * (back[j:] @ e[: max(n - j, 0)]) for j in range(1, len(ma) + 1)])
        if g:
            near = np.linalg.solve(inner, q)
            along, spread = np.zeros(len(z)), z @ near
            for j in range(min(g, len(z))):
                along[: len(z) - j] += spread[j:, j]
            twice = _convolve(np.pad(h, (0, max(len(z) - len(h), 0)))[: len(z)], h)
            by_ma -= [2 * (along[j:] @ twice[: max(len(z) - j, 0)]) for j in range(1, len(ma) + 1)]
            weight = gram @ np.linalg.inv(inner) - rate * np.outer(pull, pull)
            x = _accumulated(step.T, (weight + weight.T) / 2)
            if x is None:
                return none
            by_ar += (2 * x @ (step @ q[:, 0] + load))[: len(ar)]
            by_ma += (2 * x @ load)[: len(ma)]
        return value, by_ar, by_ma, 2 * rate * back


def _accumulated(step: np.ndarray, noise: np.ndarray) -> np.ndarray | None:
    """The sum of step^k noise step'^k over all k, doubling the horizon; None if it is not
    finite."""
    p, a = noise, step
    for _ in range(60):
        add = a @ p @ a.T
        p = p + add
        if not np.isfinite(p).all():
            return None
        if not np.abs(add).max(initial=0.0) > 1e-14 * np.abs(p).max(initial=0.0):
            break
        a = a @ a
    return p


# --- estimation --------------------------------------------------------------------------


def _lagged(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    return np.stack([x[start - j : len(x) - j] for j in range(1, lags + 1)], axis=1) if lags else np.zeros((len(x) - start, 0))


def _seed(w: np.ndarray, p: int, q: int):
    """Hannan and Rissanen: residuals of a long autoregression as regressors."""
    n = len(w)
    if p + q == 0 or n < 3 * (p + q) + 4:
        return np.zeros(p), np.zeros(q)
    if q == 0:
        fit = np.linalg.lstsq(_lagged(w, p, p), w[p:], rcond=None)[0]
        return fit, np.zeros(0)
    k = min(max(p + q + 2, int(math.log(n)), p + q + 1), max(n // 2, 1))
    k = max(k, p + q + 1)
    if n <= 2 * k + p + q:
        return np.zeros(p), np.zeros(q)
    long = np.linalg.lstsq(_lagged(w, k, k), w[k:], rcond=None)[0]
    e = np.concatenate([np.zeros(k), w[k:] - _lagged(w, k, k) @ long])
    start = k + max(p, q)
    fit = np.linalg.lstsq(np.hstack([_lagged(w, p, start), _lagged(e, q, start)]), w[start:], rcond=None)[0]
    ar, ma = fit[:p], fit[p:]
    for _ in range(20):
        if _is_stationary(ar) and _is_stationary(-ma):
            break
        ar, ma = ar * 0.8, ma * 0.8
    return ar, ma


@dataclass
class Fit:
    """A fitted model; the last three fields are what a forecast needs."""

    options: ArimaOptions
    phi: np.ndarray
    theta: np.ndarray
    seasonal_phi: np.ndarray
    seasonal_theta: np.ndarray
    beta: np.ndarray
    intercept: float
    sigma2: float
    log_likelihood: float
    aic: float
    aicc: float
    bic: float
    n_obs: int
    fitted: np.ndarray
    residuals: np.ndarray
    fitted_onestep: np.ndarray
    errors: dict = field(default_factory=dict)
    last_obs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    w_tail: np.ndarray = field(default_factory=lambda: np.zeros(0))
    eps_tail: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def ar(self) -> np.ndarray:
        return combined(self.phi, self.seasonal_phi, self.options.period, -1.0)

    @property
    def ma(self) -> np.ndarray:
        return combined(self.theta, self.seasonal_theta, self.options.period, 1.0)


class _Shape:
    """Where each block of parameters lies, and what it stands for."""

    def __init__(self, o: ArimaOptions, regressors: int, limit: float = 1.0):
        (p, _, q), (sp, _, sq) = o.order, o.seasonal
        self.o, self.sizes, self.regressors, self.limit = o, (p, sp, q, sq), regressors, limit
        self.cuts = np.cumsum([regressors, p, sp, q, sq])

    def natural(self, x: np.ndarray):
        """(regression coefficients, phi, Phi, theta, Theta)"""
        b, a, sa, m, sm = (x[i:j] for i, j in zip([0, *self.cuts[:-1]], self.cuts))
        a, sa, m, sm = (stationary(block, self.limit) for block in (a, sa, m, sm))
        return b, a, sa, -m, -sm

    def real(self, b, phi, seasonal_phi, theta, seasonal_theta) -> np.ndarray:
        """The inverse of ``natural``."""
        return np.concatenate([b, *[unconstrained(c, self.limit) for c in (phi, seasonal_phi, -theta, -seasonal_theta)]])

    def polynomials(self, phi, seasonal_phi, theta, seasonal_theta):
        m = self.o.period
        return combined(phi, seasonal_phi, m, -1.0), combined(theta, seasonal_theta, m, 1.0)


    def slopes(self, x: np.ndarray):
        """Derivatives of both polynomials: a row for each parameter after the regression's
        (those of phi and Phi for ar, of theta and Theta for ma)."""
        _, phi, seasonal_phi, theta, seasonal_theta = self.natural(x)
        a, sa, m, sm = (stationary_slopes(x[i:j], self.limit) for i, j in zip(self.cuts[:-1], self.cuts[1:]))
        period = self.o.period
        return combined_slopes(a, sa, phi, seasonal_phi, period, -1.0), combined_slopes(-m, -sm, theta, seasonal_theta, period, 1.0)


def _integrate(w: np.ndarray, start: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """The series whose differences are w and whose first values are ``start``."""
    lost = len(poly) - 1
    if lost == 0:
        return w.copy()
    out = start.tolist()
    lags = [(k, float(c)) for k, c in enumerate(poly) if k and c]
    for v in w.tolist():
        for k, c in lags:
            v -= c * out[-k]
        out.append(v)
    return np.array(out)


def fit_arima(y: np.ndarray, o: ArimaOptions, exog: np.ndarray | None = None, errors: bool = True, convention: str = "reference") -> Fit:
    """Estimates a model of y, with regressors as the columns of ``exog``.

    ``convention`` of standard errors: "mle" is the usual one, "reference" smaller by the
    square root of two (the Hessian is that of minus twice the log-likelihood).
    """
    (p, d, q), (sp, sd, sq), m = o.order, o.seasonal, o.period
    n = len(y)
    if exog is not None and exog.shape[1] == 0:
        exog = None
    if exog is not None and len(exog) != n:
        raise ExogMismatch(f"{len(exog)} rows of regressors for {n} values")
    if n < o.least:
        raise SeriesTooShort(n, o.least)
    if not np.isfinite(y).all() or (exog is not None and not np.isfinite(exog).all()):
        raise NonFinite("the series or a regressor has missing or infinite values")
    start = max(o.ar_reach, o.ma_reach)
    design = None if exog is None else np.column_stack([np.ones(n), exog])
    shape = _Shape(o, 0 if design is None else design.shape[1], 1.0 if o.method == "mle" else CSS_LIMIT)

    if design is None:
        w = difference(y, d, sd, m)
        level = float(w.mean()) if o.constant else 0.0
        centred, beta0 = w - level, np.zeros(0)
        differences = lambda b: centred
    else:
        if np.linalg.matrix_rank(design) < design.shape[1]:
            raise SingularModel("the regressors are collinear")
        beta0 = np.linalg.lstsq(design, y, rcond=None)[0]
        wy, wx = difference(y, d, sd, m), np.stack([difference(c, d, sd, m) for c in design.T], axis=1)
        differences = lambda b: wy - wx @ b
    phi0, theta0 = _seed(differences(beta0), p, q)
    x = shape.real(beta0, phi0, np.zeros(sp), theta0, np.zeros(sq))

    def conditional(x: np.ndarray) -> np.ndarray:
        b, *blocks = shape.natural(x)
        e = residuals(differences(b), *shape.polynomials(*blocks))[start:]
        return np.where(np.isfinite(e), e, 1e100)

    def conditional_slopes(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        b, *blocks = shape.natural(x)
        ar, ma = shape.polynomials(*blocks)
        by_ar, by_ma = shape.slopes(x)
        w, size = differences(b), len(e)
        h = impulse(ma, size) if len(ma) else np.ones(1)
        poly = np.concatenate([[1.0], -ar])
        columns = [-_convolve(np.convolve(c, poly)[start : len(w)], h) for c in (() if design is None else wx.T)]
        if len(by_ar):
            on = np.flatnonzero(by_ar.any(axis=0))
            lagged = np.stack([_convolve(w[start - j - 1 : len(w) - j - 1], h) for j in on.tolist()]) if len(on) else np.zeros((0, size))
            columns += list(-by_ar[:, on] @ lagged)
        if len(by_ma):
            late = _convolve(e, h)
            columns += [-np.convolve(late, np.concatenate([[0.0], d]))[:size] for d in by_ma]
        return np.stack(columns, axis=1)

    def full(x: np.ndarray) -> float:
        b, *blocks = shape.natural(x)
        return exact(differences(b), *shape.polynomials(*blocks))

    def full_slopes(x: np.ndarray) -> np.ndarray:
        b, *blocks = shape.natural(x)
        ar, ma = shape.polynomials(*blocks)
        by_ar, by_ma = shape.slopes(x)
        _, of_ar, of_ma, of_errors = exact(differences(b), ar, ma, True)
        poly = np.concatenate([[1.0], -ar])
        of_b = [] if design is None else [-(of_errors @ np.convolve(c, poly)[: len(c)]) for c in wx.T]
        return np.concatenate([of_b, by_ar @ of_ar, by_ma @ of_ma])

    settled = True
    if o.method != "mle" and len(x):
        x, settled = least_squares(conditional, x, slopes=conditional_slopes)
        if not settled:
            x, settled = simplex(lambda v: float((conditional(v) ** 2).sum()), x)
        for k in range(shape.regressors, len(x)):
            if abs(x[k]) > NEAR_LIMIT:  # a search that runs into the limit stops short of it
                at = x.copy()
                at[k] = math.copysign(AT_LIMIT, x[k])
                at = least_squares(conditional, at, slopes=conditional_slopes)[0]
                if (conditional(at) ** 2).sum() <= (conditional(x) ** 2).sum():
                    x = at
        x = newton(conditional, conditional_slopes, x)
    if o.method != "css" and len(x):
        within, shape.limit = shape.natural(x), 1.0
        x = shape.real(*within)
        best, settled = quasi_newton(full, x, gradient=full_slopes)
        if not settled:
            best, settled = simplex(full, best)
        x = best
    if not settled:
        raise NotConverged("the optimiser did not settle")

    b, phi, seasonal_phi, theta, seasonal_theta = shape.natural(x)
    ar, ma = shape.polynomials(phi, seasonal_phi, theta, seasonal_theta)
    w = differences(b)
    eps = residuals(w, ar, ma)
    m_eff = max(len(w) - start, 0)
    if o.method == "css":
        sigma2 = float((eps[start:] ** 2).sum() / m_eff) if m_eff else math.nan
    else:
        sigma2 = likelihood(w, ar, ma)[1]
    shift = level if design is None else 0.0
    intercept = level if design is None else float(b[0])
    regression = np.zeros(n) if design is None else design @ b
    base = y - regression

    innovations = Kalman(ar, ma, len(w)).errors(w)
    poly = difference_polynomial(d, sd, m)
    fitted = _integrate(w - innovations + shift, base[: o.lost], poly) + regression
    onestep = np.concatenate([y[: o.lost], y[o.lost :] - innovations])

    k = len(x) + 1 + (1 if design is None and o.constant else 0)
    logl = -0.5 * m_eff * (math.log(2 * math.pi * sigma2) + 1) if sigma2 > 0 else math.inf if sigma2 == 0 else math.nan
    aic = 2 * k - 2 * logl
    out = Fit(
        o, phi, theta, seasonal_phi, seasonal_theta, b[1:] if design is not None else np.zeros(0), intercept, sigma2, logl, aic,
        aic + 2 * k * (k + 1) / (m_eff - k - 1) if m_eff - k - 1 > 0 else math.inf, math.log(m_eff) * k - 2 * logl if m_eff else math.nan,
        m_eff, fitted, y - fitted, onestep,
        last_obs=base[n - o.lost :], w_tail=w[-max(start, 1) :], eps_tail=eps[-max(start, 1) :],
    )
    if errors:
        out.errors = _standard_errors(y, exog, out, convention)
    return out


def _standard_errors(y: np.ndarray, exog: np.ndarray | None, fit: Fit, convention: str) -> dict[str, np.ndarray]:
    """From the Hessian of the exact objective in the parameters themselves; NaN where it
    is not positive definite. With differencing the intercept has no curvature: its error
    is NaN and the others come from the rest of the Hessian."""
    o = fit.options
    (_, d, _), (_, sd, _), m = o.order, o.seasonal, o.period
    parts = [np.array([fit.intercept]), fit.beta, fit.phi, fit.seasonal_phi, fit.theta, fit.seasonal_theta]
    names = ("intercept", "beta", "phi", "seasonal_phi", "theta", "seasonal_theta")
    cuts = np.cumsum([len(p) for p in parts])
    wy = difference(y, d, sd, m)
    wx = None if exog is None else np.stack([difference(c, d, sd, m) for c in exog.T], axis=1)
    shape = _Shape(o, 0)

    def objective(points) -> np.ndarray:
        ws, ars, mas = [], [], []
        for v in points:
            c, b, *blocks = np.split(v, cuts[:-1])
            w = wy - (c if d + sd == 0 else 0.0)
            ws.append(w if wx is None else w - wx @ b)
            ar, ma = shape.polynomials(*blocks)
            ars.append(ar)
            mas.append(ma)
        return likelihoods(np.stack(ws), ars, mas)

    x = np.concatenate(parts)
    h = hessian(None, x, objective)
    on = np.arange(len(x)) if d + sd == 0 else np.arange(1, len(x))
    se = np.full(len(x), np.nan)
    if len(on) and np.isfinite(h[np.ix_(on, on)]).all():
        try:
            np.linalg.cholesky(h[np.ix_(on, on)])
            se[on] = np.sqrt(np.diag(np.linalg.inv(h[np.ix_(on, on)])))
        except np.linalg.LinAlgError:
            pass
    if convention == "mle":
        se = se * math.sqrt(2)
    return dict(zip(names, np.split(se, cuts[:-1])))


# --- forecasts ---------------------------------------------------------------------------


def psi_weights(ar: np.ndarray, ma: np.ndarray, steps: int) -> np.ndarray:
    out = np.zeros(max(steps, 1))
    out[0] = 1.0
    for k in range(1, steps):
        j = min(k, len(ar))
        out[k] = (ma[k - 1] if k <= len(ma) else 0.0) + ar[:j] @ out[k - j : k][::-1]
    return out


def forecast(fit: Fit, steps: int, alpha: float = 0.05, exog: np.ndarray | None = None):
    """mean, variance, lower and upper for 1 .. steps."""
    o, ar, ma = fit.options, fit.ar, fit.ma
    if len(fit.beta) and (exog is None or exog.shape != (steps, len(fit.beta))):
        raise ExogMismatch(f"{steps} rows of {len(fit.beta)} future regressors are needed")
    w, e = fit.w_tail.tolist(), fit.eps_tail.tolist()
    for _ in range(steps):
        v = sum(c * w[-j - 1] for j, c in enumerate(ar.tolist())) + sum(c * e[-j - 1] for j, c in enumerate(ma.tolist()))
        w.append(v)
        e.append(0.0)
    ahead = np.array(w[len(w) - steps :]) + (0.0 if len(fit.beta) else fit.intercept)
    poly = difference_polynomial(o.order[1], o.seasonal[1], o.period)
    mean = _integrate(ahead, fit.last_obs, poly)[len(fit.last_obs) :] if len(poly) > 1 else ahead
    if len(fit.beta):
        mean = mean + fit.intercept + exog @ fit.beta
    psi = psi_weights(ar, ma, steps)
    for _ in range(o.order[1]):
        psi = np.cumsum(psi)
    for _ in range(o.seasonal[1]):
        for k in range(o.period, steps):
            psi[k] += psi[k - o.period]
    variance = fit.sigma2 * np.cumsum(psi[:steps] ** 2)
    reach = normal_quantile(1 - alpha / 2) * np.sqrt(variance)
    return mean, variance, mean - reach, mean + reach


# --- order search ------------------------------------------------------------------------


def auto_arima(y: np.ndarray, o: AutoArimaOptions) -> Fit:
    """Stepwise search for the least AICc: differencing by tests, a slate of starts, then
    all neighbours of the best one, until none is better."""
    if not np.isfinite(y).all():
        raise NonFinite("the series has missing or infinite values")
    seasonal = o.period >= 2
    sd = nsdiffs(y, o.period, o.max_seasonal_d) if seasonal else 0
    rest = difference(y, 0, sd, o.period)
    d = ndiffs(rest, o.max_d) if len(rest) >= 8 else 0
    constant = d + sd < 2 if o.constant is None else o.constant
    tried: dict[tuple, Fit | None] = {}
    best: list = [None, None]

    def attempt(key: tuple) -> None:
        p, q, sp, sq, with_constant = key
        if key in tried or max(p + sp, q + sq) > 6 or (with_constant and d + sd >= 2):
            return
        tried[key] = None
        try:
            options = ArimaOptions((p, d, q), (sp, sd, sq), o.period if seasonal else 0, with_constant, o.method)
            tried[key] = fit = fit_arima(y, options, errors=False)
        except (SeriesTooShort, NotConverged, SingularModel, np.linalg.LinAlgError):
            return
        if math.isfinite(fit.aicc) and (best[1] is None or fit.aicc < best[1].aicc):
            best[:] = key, fit

    starts = [(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)] if seasonal else [(2, 2, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0)]
    limits = (o.max_p, o.max_q, o.max_seasonal_p if seasonal else 0, o.max_seasonal_q if seasonal else 0)
    for s in starts:
        if all(a <= b for a, b in zip(s, limits)):
            attempt((*s, constant))
    if best[1] is None:
        attempt((0, 0, 0, 0, constant))
    if best[1] is None:
        raise NotConverged("no model could be fitted")
    for _ in range(o.max_rounds):
        key, before = best[0], best[1].aicc
        near = [(*key[:k], key[k] + s, *key[k + 1 :]) for k in range(4) for s in (1, -1) if 0 <= key[k] + s <= limits[k]]
        if o.constant is None:
            near.append((*key[:4], not key[4]))
        for other in near:
            attempt(other)
        if not best[1].aicc < before - 1e-9:
            break
    fit = best[1]
    fit.errors = _standard_errors(y, None, fit, "reference")
    return fit
