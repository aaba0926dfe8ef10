"""Normal, chi-squared and Student-t helpers that stay in the JVM as plain column arithmetic.

``erfc`` uses the rational minimax approximations published by W. J. Cody
(Math. Comp. 23, 1969), good to about 1e-16 relative. The same three branch
formulas serve Spark columns and numpy arrays.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's published coefficients, highest power first.
_ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
            3.77485237685302021e2, 3.20937758913846947e3)
_ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2,
            1.28261652607737228e3, 2.84423683343917062e3)
_MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
            6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
            1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
            1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
            3.43936767414372164e3, 1.23033935480374942e3)
_TAIL_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
             1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_TAIL_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
             6.05183413124413191e-2, 2.33520497626869185e-3)

_SQRT_PI = math.sqrt(math.pi)
_SQRT_2PI = math.sqrt(2.0 * math.pi)
_FAR = 26.0  # erfc is below 1e-290 from here on


def _poly(coefficients, x):
    total = coefficients[0] * x + coefficients[1]
    for c in coefficients[2:]:
        total = total * x + c
    return total


def _erf_near(a):
    return a * _poly(_ERF_NUM, a * a) / _poly(_ERF_DEN, a * a)


def _erfc_mid(a, gauss):
    return gauss * _poly(_MID_NUM, a) / _poly(_MID_DEN, a)


def _erfc_tail(a, gauss):
    z = 1.0 / (a * a)
    return gauss / a * (1.0 / _SQRT_PI - z * _poly(_TAIL_NUM, z) / _poly(_TAIL_DEN, z))


def erfc(x: Column) -> Column:
    """Complementary error function."""
    a = F.least(F.abs(x), F.lit(_FAR))
    gauss = F.exp(-a * a)
    upper = F.when(a <= 0.46875, 1.0 - _erf_near(a)).when(a <= 4.0, _erfc_mid(a, gauss)).otherwise(
        _erfc_tail(a, gauss))
    return F.when(x.isNull(), F.lit(None)).when(x < 0, 2.0 - upper).otherwise(upper)


def _upper_array(a: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    """erfc for a >= 0 given exp(-a^2); the rare branches only touch their own elements."""
    upper = _erfc_mid(a, gauss)
    near, far = a <= 0.46875, a > 4.0
    upper[near] = 1.0 - _erf_near(a[near])
    if far.any():
        upper[far] = _erfc_tail(a[far], gauss[far])
    return upper


def erfc_array(x: np.ndarray) -> np.ndarray:
    """``erfc`` over an array, for work inside Arrow batches."""
    a = np.minimum(np.abs(x), _FAR)
    upper = _upper_array(a, np.exp(-a * a))
    return np.where(x < 0, 2.0 - upper, upper)


def normal_arrays(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Density and distribution function together; they share one exponential."""
    a = np.minimum(np.abs(x) * math.sqrt(0.5), _FAR)
    gauss = np.exp(-a * a)
    half = 0.5 * _upper_array(a, gauss)
    return gauss / _SQRT_2PI, np.where(x < 0, half, 1.0 - half)


def _log_gamma(a: Column) -> Column:
    """ln of the gamma function for a > 0: Stirling's series, after lifting small arguments above 10."""
    z = F.when(a < 10.0, a + 10.0).otherwise(a)
    lifted = reduce(lambda x, k: x + F.ln(a + float(k)), range(1, 10), F.ln(a))
    return (z - 0.5) * F.ln(z) - z + math.log(_SQRT_2PI) + _stirling(z) - F.when(a < 10.0, lifted).otherwise(0.0)


def _stirling(z: Column) -> Column:
    return 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3) + 1.0 / (1260.0 * z**5) - 1.0 / (1680.0 * z**7)


def chi2_upper_tail(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-squared variable with ``df`` >= 1 degrees of freedom.

    The regularised incomplete gamma function at a = df/2, h = x/2: its power
    series where h < a + 1, its continued fraction beyond. Either settles within
    a multiple of sqrt(a) terms, so tables of any size are in reach, and no
    intermediate leaves the range of doubles: the factor h^a exp(-h) / gamma(a)
    is formed from its logarithm, around h = a without cancelling. Results below
    the smallest double are 0; ``chi2_log_upper_tail`` tells those apart too.
    """
    a, h = df.cast("double") / 2.0, x.cast("double") / 2.0
    factor = F.exp(_log_factor(a, h))
    tail = F.when(h < a + 1.0, 1.0 - factor * _series(a, h)).otherwise(factor * _fraction(a, h))
    tail = F.when(h <= 0.0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(tail, F.lit(1.0))))
    return F.when(x.isNotNull() & (df >= 1), tail)


def chi2_log_upper_tail(x: Column, df: Column) -> Column:
    """Natural logarithm of the upper tail, however small the tail is."""
    a, h = df.cast("double") / 2.0, x.cast("double") / 2.0
    log = _log_factor(a, h)
    below = F.log1p(-F.least(F.exp(log) * _series(a, h), F.lit(1.0)))
    tail = F.when(h < a + 1.0, below).otherwise(log + F.ln(_fraction(a, h)))
    tail = F.when(h <= 0.0, F.lit(0.0)).otherwise(F.least(tail, F.lit(0.0)))
    return F.when(x.isNotNull() & (df >= 1), tail)


def _log_factor(a: Column, h: Column) -> Column:
    """ln of h^a exp(-h) / gamma(a)."""
    off = (h - a) / a
    near = -a * (off - F.log1p(off)) + 0.5 * F.ln(a) - math.log(_SQRT_2PI) - _stirling(a)
    return F.when(a >= 10.0, near).otherwise(a * F.ln(h) - h - _log_gamma(a))


def _steps(a: Column) -> Column:
    return F.sequence(F.lit(1), (60 + 30 * F.sqrt(a)).cast("int"))


def _series(a: Column, h: Column) -> Column:
    return F.aggregate(
        _steps(a),
        F.struct((1.0 / a).alias("term"), (1.0 / a).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * h / (a + k)).alias("term"),
            (acc["total"] + acc["term"] * h / (a + k)).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def _fraction(a: Column, h: Column) -> Column:
    tiny = 1e-300
    b = lambda k: h + 2.0 * k + 1.0 - a
    n = lambda k: -k * (k - a)

    def step(acc: Column, k: Column) -> Column:
        d = n(k) * acc["d"] + b(k)
        c = b(k) + n(k) / acc["c"]
        d, c = (F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v) for v in (d, c))
        return F.struct((1.0 / d).alias("d"), c.alias("c"), (acc["f"] * c / d).alias("f"))

    first = 1.0 / b(F.lit(0))
    return F.aggregate(
        _steps(a),
        F.struct(first.alias("d"), F.lit(1.0 / tiny).alias("c"), first.alias("f")),
        step,
        lambda acc: acc["f"],
    )


def _t_cdf(t: float, nu: int) -> float:
    """Student-t distribution function for whole degrees of freedom (finite trigonometric series)."""
    theta = math.atan2(t, math.sqrt(nu))
    cos2 = math.cos(theta) ** 2
    if nu % 2:
        term, total = math.cos(theta), 0.0
        for k in range(1, (nu - 1) // 2 + 1):
            total += term
            term *= cos2 * (2 * k) / (2 * k + 1)
        area = 2.0 / math.pi * (theta + math.sin(theta) * total)
    else:
        term, total = 1.0, 0.0
        for k in range(1, nu // 2 + 1):
            total += term
            term *= cos2 * (2 * k - 1) / (2 * k)
        area = math.sin(theta) * total
    return 0.5 + 0.5 * area


def _bisect(cdf, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return 0.5 * (low + high)


def t_quantile_value(p: float, nu: int) -> float:
    return _bisect(lambda t: _t_cdf(t, nu), p, 0.0, 1e6)


def normal_quantile_value(p: float) -> float:
    return _bisect(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)), p, 0.0, 40.0)


_T_SERIES_FROM = 100


def t_quantile(p: float, nu: Column) -> Column:
    """Student-t quantile (p >= 0.5) for a column of degrees of freedom.

    Up to 100 degrees it is solved once while the plan is built and embedded
    as an array; beyond, the Cornish-Fisher series is exact to 1e-10.
    """
    z = normal_quantile_value(p)
    c1 = (z**3 + z) / 4.0
    c2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
    c3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
    c4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160.0
    v = nu.cast("double")
    series = F.lit(z) + c1 / v + c2 / (v * v) + c3 / (v * v * v) + c4 / (v * v * v * v)
    small = F.array(*[F.lit(t_quantile_value(p, k)) for k in range(1, _T_SERIES_FROM + 1)])
    return F.when(nu > _T_SERIES_FROM, series).when(
        nu >= 1, F.get(small, (nu - 1).cast("int")))
