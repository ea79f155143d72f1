"""Special functions on numpy arrays: normal law, Student's t and chi-square tails."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from fathomline.functions.normal import DENOMINATOR, LOG_ROOT_TWO_PI, NUMERATOR, ROOT_TWO_PI, SWITCH, norm_cdf_sql

#: Upper tail over density at a >= 0 is t times the polynomial in 2 t - 1, t = TAIL_SCALE / (TAIL_SCALE + a); a Chebyshev series in powers.
TAIL_SCALE = 6.0
TAIL = (
    1.4218224327761983e-10, -1.5062016437827911e-10, -1.949515264835733e-09, 1.1813290669490401e-09, 1.7144519889199668e-08, 2.8606902515596797e-09, -1.2826570576714973e-07, -1.794408490895706e-07,
    7.507328963384781e-07, 2.8394698292327547e-06, -4.488051127014247e-07, -2.7051638635254803e-05, -7.576735807097085e-05, 1.3732190715428813e-05, 0.0008905236799214929, 0.0041901719937966235,
    0.012944777988007165, 0.031404674879799685, 0.06378543111190832, 0.11195197024989122, 0.17291707184603544, 0.23769891860140155, 0.2928615090573506, 0.3247553217937349,
)

#: Coefficients of a published rational approximation of the normal quantile (Acklam), refined below.
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def horner(coefficients: Sequence[float], x: np.ndarray) -> np.ndarray:
    """A polynomial, highest power first."""
    out = coefficients[0] * x
    for c in coefficients[1:-1]:
        out += c
        out *= x
    out += coefficients[-1]
    return out


def ndtr(x: np.ndarray) -> np.ndarray:
    """Normal distribution function."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 38.0)
    low = np.asarray(horner(NUMERATOR, a) / horner(DENOMINATOR, a))
    far = ~(a < SWITCH)
    if far.any():
        tail = a[far] + 0.65
        for k in (4, 3, 2, 1):
            tail = a[far] + k / tail
        low[far] = 1 / (tail * ROOT_TWO_PI)
    low = np.exp(-0.5 * a * a) * low
    return np.where(x > 0, 1 - low, low)


def log_ndtr(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    far = np.minimum(x, -20.0)
    square = far * far
    series = np.log1p(-1 / square + 3 / square**2 - 15 / square**3 + 105 / square**4)
    near = np.maximum(x, -20.0)
    return np.where(x < -20, -0.5 * square - np.log(-far) - LOG_ROOT_TWO_PI + series, np.log(np.maximum(ndtr(near), 1e-300)))


def log_pdf(x: np.ndarray) -> np.ndarray:
    return -0.5 * x * x - LOG_ROOT_TWO_PI


def mills(x: np.ndarray) -> np.ndarray:
    """Density over distribution function."""
    return np.exp(log_pdf(x) - log_ndtr(x))


def log_ndtr_mills(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log_ndtr and mills, smooth to the last digits: those above have steps of 1e-8 where one approximation gives way to the next."""
    a, low = np.abs(x), x < 0
    t = TAIL_SCALE / (TAIL_SCALE + a)
    tail, density = horner(TAIL, 2 * t - 1) * t, np.exp(log_pdf(x))
    below = np.where(low, 0.0, density * tail)
    tail = np.where(low, tail, 1.0)
    return np.where(low, np.log(tail) + log_pdf(x), np.log1p(-below)), np.where(low, 1 / tail, density / (1 - below))


def ndtri(p: np.ndarray) -> np.ndarray:
    """Normal quantile; one Halley step on the rational start."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5)
    low = np.minimum(q, 1 - q)
    d = q - 0.5
    x = np.asarray(horner(QUANTILE_A, d * d) * d / horner(QUANTILE_B, d * d))
    if (far := low < 0.02425).any():
        t = np.sqrt(-2 * np.log(low[far]))
        x[far] = np.copysign(horner(QUANTILE_C, t) / horner(QUANTILE_D, t), d[far])
    e = (ndtr(x) - q) * math.sqrt(2 * math.pi) * np.exp(0.5 * x * x)
    x = x - e / (1 + 0.5 * x * e)
    return np.where(inside, x, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


def ndtri_sql(p: str) -> str:
    """The same as SQL text over a column p that lies within 0 and 1: the rational start, then the step; p is a column's name."""

    def horner(coefficients: tuple[float, ...], x: str) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    t, d = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    outer = f"({horner(QUANTILE_C, t)} / {horner(QUANTILE_D, t)})"
    start = f"(CASE WHEN {p} < 0.02425 THEN {outer} WHEN {p} > 1 - 0.02425 THEN -{outer} ELSE {horner(QUANTILE_A, f'({d} * {d})')} * {d} / {horner(QUANTILE_B, f'({d} * {d})')} END)"
    error = f"((({norm_cdf_sql('x')}) - {p}) * sqrt(2 * pi()) * exp(0.5 * x * x))"
    return f"list_transform([{start}], lambda x: x - {error} / (1 + 0.5 * x * {error}))[1]"


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_sf(middle, df) < p else (low, middle)
    return (low + high) / 2


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square law by the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
