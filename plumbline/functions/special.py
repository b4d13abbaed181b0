"""Probability functions that SQL lacks. They are applied to k-row results or to one bounded sample."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


def _incomplete_beta_tail(a, b, x):
    """Continued fraction of the regularised incomplete beta function, modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a, b, x):
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _incomplete_beta_tail(a, b, x) / a
    return 1.0 - front * _incomplete_beta_tail(b, a, 1.0 - x) / b


def correlation_p(r, n):
    """Two-sided p of Pearson's r (also of a simple regression slope) from n pairs."""
    if r is None or n is None or math.isnan(r) or n < 2:
        return float("nan")
    if n == 2:
        return 1.0
    freedom = n - 2
    unexplained = max(0.0, 1.0 - r * r)
    if unexplained == 0.0:
        return 0.0
    # x = v / (v + t^2) equals 1 - r^2 for t = r * sqrt(v / (1 - r^2)).
    return incomplete_beta(freedom / 2.0, 0.5, unexplained)


@F.pandas_udf(T.DoubleType())
def p_of_r(r: pd.Series, n: pd.Series) -> pd.Series:
    values = [correlation_p(a, b) for a, b in zip(r.to_numpy(dtype=float), n.to_numpy(dtype=float))]
    return pd.Series([None if math.isnan(v) else v for v in values], dtype="float64")


def _poly(coefficients, x):
    return sum(c * x**i for i, c in enumerate(coefficients))


# The polynomial coefficients published with the W test approximation
# (Royston 1995, Applied Statistics 44, algorithm AS R94), lowest power first.
_W_TOP_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_W_NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_W_SMALL_GAMMA = (-2.273, 0.459)
_W_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_W_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_W_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_W_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values):
    """(W, p) of the Shapiro-Wilk test for 3..5000 values, by Royston's approximation."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return (1.0, 1.0) if n >= 3 else (math.nan, math.nan)
    scores = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm2 = float(scores @ scores)
    root = 1.0 / math.sqrt(n)
    weights = scores / math.sqrt(norm2)
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        top = weights[-1] + _poly(_W_TOP_WEIGHT, root)
        if n <= 5:
            scale = math.sqrt((norm2 - 2 * scores[-1] ** 2) / (1 - 2 * top**2))
            weights = scores / scale
        else:
            second = weights[-2] + _poly(_W_NEXT_WEIGHT, root)
            scale = math.sqrt(
                (norm2 - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * top**2 - 2 * second**2)
            )
            weights = scores / scale
            weights[1], weights[-2] = -second, second
        weights[0], weights[-1] = -top, top
    centred = x - x.mean()
    w = min(1.0, float(weights @ centred) ** 2 / float(centred @ centred))
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    if w >= 1.0:
        return w, 1.0
    y = math.log1p(-w)
    if n <= 11:
        gamma = _poly(_W_SMALL_GAMMA, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = _poly(_W_SMALL_MEAN, n), math.exp(_poly(_W_SMALL_LOG_SD, n))
    else:
        log_n = math.log(n)
        mean, sd = _poly(_W_LARGE_MEAN, log_n), math.exp(_poly(_W_LARGE_LOG_SD, log_n))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))
