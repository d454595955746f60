"""Numerical helpers of the kernels."""

from __future__ import annotations

import math

import numpy as np

# Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_quantile(p):
    """Inverse of the normal distribution function, to about 1e-9 (arrays too)."""
    p = np.asarray(p, float)
    tail = np.sqrt(-2 * np.log(np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)))
    outer = np.polyval(_C, tail) / np.polyval((*_D, 1.0), tail)
    q = p - 0.5
    inner = np.polyval(_A, q * q) * q / np.polyval((*_B, 1.0), q * q)
    out = np.where(p < 0.02425, outer, np.where(p > 1 - 0.02425, -outer, inner))
    out = np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))
    return out if out.ndim else float(out)


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    if x <= 0:
        return 1.0
    z = (np.cbrt(x / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return min(max(1 - normal_cdf(z), 0.0), 1.0)


def normal_cdf(z: float) -> float:
    """By the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * math.exp(-x * x)
    return 0.5 * (1 + math.copysign(erf, z))


def golden_minimum(f, low: float, high: float, tolerance: float = 1e-8, most: int = 200) -> float:
    """Golden section search; the better of the last two inner points."""
    part = (3 - math.sqrt(5)) / 2
    a, b = low + part * (high - low), high - part * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(most):
        if high - low < tolerance:
            break
        if fa < fb:
            high, b, fb = b, a, fa
            a = low + part * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = high - part * (high - low)
            fb = f(b)
    return a if fa < fb else b


def interpolate(y: np.ndarray) -> np.ndarray:
    """Missing values on lines between their neighbours; ends take the nearest value."""
    good = np.isfinite(y)
    if good.all() or not good.any():
        return y
    at = np.arange(len(y))
    return np.interp(at, at[good], y[good])
