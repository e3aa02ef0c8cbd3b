"""Upper tails of the normal and the F distribution as column expressions.

Neither Spark nor the ANSI dialects have ``erf`` or an incomplete beta function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Rational approximation of the normal tail (Hart 1968, in the form of West 2005).
NORMAL_NUMERATOR = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
NORMAL_DENOMINATOR = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
NORMAL_SWITCH = 7.07106781186547
NORMAL_FRACTION = 0.65
SQRT_TWO_PI = 2.506628274631


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_two_sided_p(z: Column) -> Column:
    """Probability that a standard normal variable is at least ``|z|`` away from 0."""
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    near = density * _horner(x, NORMAL_NUMERATOR) / _horner(x, NORMAL_DENOMINATOR)
    fraction = x + F.lit(NORMAL_FRACTION)
    for k in (4, 3, 2, 1):
        fraction = x + F.lit(float(k)) / fraction
    far = density / fraction / F.lit(SQRT_TWO_PI)
    return 2 * F.when(x < NORMAL_SWITCH, near).otherwise(far)


def f_upper_p_even(f: Column, d1: Column, d2: Column) -> Column:
    """P(F >= f) for an even ``d1``: a finite sum, exact for any ``d2``."""
    z = d2 / (d2 + d1 * f)
    a = d2 / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    steps = F.sequence(F.lit(1), F.greatest(F.floor(d1 / 2), F.lit(1)).cast("int"))
    total = F.aggregate(
        steps,
        start,
        lambda s, j: F.struct(
            (s["term"] * (a + j - 1) / j * (1 - z)).alias("term"),
            (s["total"] + s["term"]).alias("total"),
        ),
        lambda s: s["total"],
    )
    return F.pow(z, a) * total


@F.pandas_udf(DoubleType())
def f_upper_p_odd(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F >= f) by the continued fraction of the incomplete beta; one row per test."""
    rows = zip(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float))
    return pd.Series([_beta_ratio(n / (n + m * v), n / 2, m / 2) for v, m, n in rows], dtype=float)


def _beta_ratio(x: float, a: float, b: float) -> float:
    if not np.isfinite(x):
        return math.nan
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_ratio(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + even * d or tiny)
        c = 1.0 + even / c or tiny
        value *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + odd * d or tiny)
        c = 1.0 + odd / c or tiny
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value / a
