"""Composed-error densities, likelihoods, scores and efficiencies as column expressions at given parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.normal import LOG_ROOT_TWO_PI, log_norm_cdf, mills, norm_cdf, norm_pdf


def residual(y: Column, terms: list[tuple[float, Column]]) -> Column:
    out = y
    for b, x in terms:
        out = out - b * x
    return out


def log_density_hn(e: Column, s2u: Column, s2v: Column, s: int = 1) -> Column:
    """Half-normal: log of (2 / sigma) phi(e / sigma) Phi(-s e lambda / sigma)."""
    s2 = s2u + s2v
    sigma = F.sqrt(s2)
    return math.log(2) - F.log(sigma) - LOG_ROOT_TWO_PI - 0.5 * e * e / s2 + log_norm_cdf(-s * e * F.sqrt(s2u / s2v) / sigma)


def log_density_tn(e: Column, mu: Column, s2u: Column, s2v: Column, s: int = 1) -> Column:
    """Truncated normal with mean mu before truncation; mu enters with the frontier's orientation."""
    s2 = s2u + s2v
    sigma = F.sqrt(s2)
    centre = (mu * s2v - s * e * s2u) / s2
    spread = F.sqrt(s2u * s2v / s2)
    z = (e + s * mu) / sigma
    return -LOG_ROOT_TWO_PI - 0.5 * z * z - F.log(sigma) + log_norm_cdf(centre / spread) - log_norm_cdf(mu / F.sqrt(s2u))


def conditional(e: Column, s2u: Column, s2v: Column, s: int = 1) -> tuple[Column, Column]:
    """mu* and sigma* of inefficiency given the composed error."""
    s2 = s2u + s2v
    return -s * e * s2u / s2, F.sqrt(s2u * s2v / s2)


def jlms(e: Column, s2u: Column, s2v: Column, s: int = 1) -> Column:
    """Expected inefficiency given the composed error."""
    mu, sd = conditional(e, s2u, s2v, s)
    return mu + sd * mills(mu / sd)


def battese_coelli(e: Column, s2u: Column, s2v: Column, s: int = 1) -> Column:
    """Expected efficiency exp(-u) given the composed error."""
    mu, sd = conditional(e, s2u, s2v, s)
    m = mu / sd
    return F.exp(-mu + 0.5 * sd * sd + log_norm_cdf(m - sd) - log_norm_cdf(m))


def score_hn(e: Column, s2u: Column, s2v: Column, s: int = 1) -> tuple[Column, Column, Column]:
    """Derivatives of the half-normal log density by the frontier's fitted value, log s2u and log s2v."""
    s2 = s2u + s2v
    sigma, lam = F.sqrt(s2), F.sqrt(s2u / s2v)
    a = -s * e * lam / sigma
    m = mills(a)
    by_sigma = ((e / sigma) * (e / sigma) - m * a - 1) / sigma
    by_lambda = -s * m * e / sigma
    return e / s2 + s * m * lam / sigma, 0.5 * lam * by_lambda + 0.5 * s2u / sigma * by_sigma, -0.5 * lam * by_lambda + 0.5 * s2v / sigma * by_sigma


def log_sum_exp(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """log sum exp of a column for each key: the largest term first, then the sum relative to it."""
    top = F.max(column).over(Window.partitionBy(*keys))
    shifted = df.withColumn("_top", top)
    return shifted.groupBy(*keys).agg((F.first("_top") + F.log(F.sum(F.exp(F.col(column) - F.col("_top"))))).alias(name))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(c - top) for c in scores]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def transitions(scores: list[list[Column]]) -> list[list[Column]]:
    """Probabilities of moving from each class to each: a softmax of the class's scores, with 0 for staying.

    scores[i] are those of the other classes in order, so one fewer than there are classes.
    """
    if any(len(s) != len(scores) - 1 for s in scores):
        raise ValueError("each class needs a score for every other")
    return [softmax([*s[:i], F.lit(0.0), *s[i:]]) for i, s in enumerate(scores)]


def log_add(terms: list[Column]) -> Column:
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.log(total)


def wang_hn(gamma: float, s2u: Column) -> Column:
    """Marginal effect of a variance determinant on E[u], half-normal."""
    return gamma * F.sqrt(s2u) / 2 * math.sqrt(2 / math.pi)


def wang_tn(delta: float, gamma: float, mu: Column, s2u: Column) -> Column:
    """The same for the truncated normal with mean mu = z'delta."""
    sigma = F.sqrt(s2u)
    big = mu / sigma
    alpha = norm_pdf(big) / norm_cdf(big)
    return delta * (1 - big * alpha - alpha * alpha) + gamma * sigma / 2 * ((1 + big * big) * alpha + big * alpha * alpha)


def kumbhakar_sun_hn(gamma_u: float, e: Column, s2u: Column, s2v: Column, s: int = 1) -> Column:
    """Derivative of E[u | e] by a variance determinant, half-normal: the chain rule through mu* and sigma*."""
    mu, sd = conditional(e, s2u, s2v, s)
    m = mu / sd
    h = mills(m)
    share = s2v / (s2u + s2v)
    d_mu, d_sd = mu * share * gamma_u, 0.5 * sd * share * gamma_u
    return d_mu + d_sd * h - sd * h * (m + h) * (d_mu - m * d_sd) / sd
