"""Normal law as plain column expressions, which stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a published rational approximation of the normal distribution in double precision (Hart).
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SWITCH, ROOT_TWO_PI = 7.07106781186547, 2.506628274631
LOG_ROOT_TWO_PI = 0.5 * math.log(2 * math.pi)


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Distribution function; the lower tail keeps its relative precision."""
    a = F.abs(x)

    def horner(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + c
        return out

    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    lower = F.exp(-0.5 * a * a) * F.when(a < SWITCH, horner(NUMERATOR) / horner(DENOMINATOR)).otherwise(1.0 / tail / ROOT_TWO_PI)
    return F.when(x > 0, 1.0 - lower).otherwise(lower)


def norm_cdf_sql(x: str) -> str:
    """The same as SQL text, for engines without a normal distribution."""

    def horner(coefficients: tuple[float, ...]) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * abs({x}) + {c!r})"
        return out

    tail = f"(abs({x}) + 0.65)"
    for k in (4, 3, 2, 1):
        tail = f"(abs({x}) + {k}.0 / {tail})"
    low = f"(exp(-0.5 * ({x}) * ({x})) * CASE WHEN abs({x}) < {SWITCH!r} THEN {horner(NUMERATOR)} / {horner(DENOMINATOR)} ELSE 1.0 / {tail} / {ROOT_TWO_PI!r} END)"
    return f"CASE WHEN ({x}) > 0 THEN 1.0 - {low} ELSE {low} END"


def log_norm_cdf(x: Column) -> Column:
    """Logarithm of the distribution function; far below zero by its asymptotic form."""
    far = -0.5 * x * x - F.log(-x) - LOG_ROOT_TWO_PI + F.log1p(-1.0 / (x * x) + 3.0 / (x * x * x * x))
    return F.when(x < -30.0, far).otherwise(F.log(norm_cdf(x)))


def mills(x: Column) -> Column:
    """Density over distribution function."""
    return F.when(x < -30.0, -x - 1.0 / x).otherwise(norm_pdf(x) / norm_cdf(x))


def radical_inverse(index: Column, base: int) -> Column:
    """Unscrambled Halton number of a positive index: its digits in the base, mirrored at the point."""
    digits = int(math.ceil(31 * math.log(2) / math.log(base)))
    out = F.lit(0.0)
    for k in range(digits):
        out = out + F.pmod(F.floor(index / F.lit(float(base**k))), F.lit(base)) * F.lit(1.0 / base ** (k + 1))
    return out
