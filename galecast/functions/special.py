"""Log-gamma, digamma and trigamma as Column expressions.

Spark SQL has no gamma-family functions.  The count models need them for
log-likelihoods (``lgamma(y + 1)``, ``lgamma(y + theta)``) and for the
theta score.  Each is written as an argument shift by ``SHIFT`` followed by
the asymptotic series, which is accurate to about 1e-14 for arguments > 0.
They compile into whole-stage codegen like any arithmetic expression, so no
Python runs per row.  The ``*_py`` twins are used on the driver for scalars.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x) -> Column:
    x = _c(x)
    w = x + SHIFT
    prod = x
    for k in range(1, SHIFT):
        prod = prod * (x + k)
    inv = 1.0 / w
    inv2 = inv * inv
    series = inv * (1.0 / 12 - inv2 * (1.0 / 360 - inv2 * (1.0 / 1260 - inv2 * (1.0 / 1680))))
    return (w - 0.5) * F.log(w) - w + _HALF_LOG_2PI + series - F.log(prod)


def digamma(x) -> Column:
    x = _c(x)
    w = x + SHIFT
    shift_sum = sum((1.0 / (x + k) for k in range(1, SHIFT)), 1.0 / x)
    inv2 = 1.0 / (w * w)
    series = inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240))))
    return F.log(w) - 0.5 / w - series - shift_sum


def trigamma(x) -> Column:
    x = _c(x)
    w = x + SHIFT
    shift_sum = sum((1.0 / ((x + k) * (x + k)) for k in range(1, SHIFT)), 1.0 / (x * x))
    inv = 1.0 / w
    inv2 = inv * inv
    series = inv + inv2 / 2 + inv * inv2 * (1.0 / 6 - inv2 * (1.0 / 30 - inv2 * (1.0 / 42 - inv2 / 30)))
    return series + shift_sum


def digamma_py(x: float) -> float:
    w = x + SHIFT
    s = sum(1.0 / (x + k) for k in range(SHIFT))
    inv2 = 1.0 / (w * w)
    return math.log(w) - 0.5 / w - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240))) - s


def trigamma_py(x: float) -> float:
    w = x + SHIFT
    s = sum(1.0 / ((x + k) ** 2) for k in range(SHIFT))
    inv = 1.0 / w
    inv2 = inv * inv
    return inv + inv2 / 2 + inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30))) + s


def gamma_np(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lgamma, digamma and trigamma of an array of positive numbers, by the same series."""
    x = np.asarray(x, float)
    w, steps = x + SHIFT, x[..., None] + np.arange(SHIFT)
    inv = 1.0 / w
    inv2 = inv * inv
    log = np.log(w)
    first = ((w - 0.5) * log - w + 0.5 * math.log(2.0 * math.pi)
             + inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680))) - np.log(steps).sum(axis=-1))
    second = log - 0.5 * inv - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240))) - (1.0 / steps).sum(axis=-1)
    third = inv + inv2 / 2 + inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30))) + (1.0 / steps ** 2).sum(axis=-1)
    return first, second, third


def norm_sf2(z: float) -> float:
    """Two-sided normal tail probability, P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))
