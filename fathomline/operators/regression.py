"""Regressions from sums of cross-products: one pass over the rows, a small solve on the driver or in the plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.panel import within


def moments(df: DataFrame, columns: Sequence[Column]) -> tuple[np.ndarray, int]:
    """Sums of products of every two columns, and the number of rows; partial before the shuffle."""
    row = df.agg(F.count("*"), *[F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i + 1)]).first()
    full = np.zeros((len(columns), len(columns)))
    full[np.tril_indices(len(columns))] = row[1:]
    return full + np.tril(full, -1).T, int(row[0])


def cross_products(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n with an intercept first."""
    full, n = moments(df, [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)])
    return full[:-1, :-1], full[:-1, -1], float(full[-1, -1]), n


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> np.ndarray:
    """Least-squares coefficients, intercept first."""
    xx, xy, _, _ = cross_products(df, y, xs)
    return np.linalg.lstsq(xx, xy, rcond=None)[0]


def ols_single(df: DataFrame, y: str, x: str) -> DataFrame:
    """(n, slope, intercept) of y on x as one aggregate."""
    return df.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fixed_effects(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept) of y on x with an effect for each id."""
    sums = within(df, [y, x]).agg(F.sum(F.col(f"{x}_w") * F.col(f"{y}_w")).alias("xy"), F.sum(F.col(f"{x}_w") * F.col(f"{x}_w")).alias("xx"), F.avg(y).alias("my"), F.avg(x).alias("mx"))
    slope = F.col("xy") / F.col("xx")
    return sums.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def random_effects(df: DataFrame, y: str, x: str) -> DataFrame:
    """(sigma2_e, sigma2_v, slope, intercept): feasible generalised least squares for unbalanced panels, one regressor.

    The within and between residual variances give each id's share theta of its means to take away.
    """
    per = df.groupBy("id").agg(
        F.count("*").alias("t"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy")
    )
    t, my, mx = F.col("t"), F.col("my"), F.col("mx")
    wyy, wxx, wxy = F.col("yy") - t * my * my, F.col("xx") - t * mx * mx, F.col("xy") - t * mx * my
    sums = per.agg(
        F.count("*").alias("nf"), F.sum(t).alias("n"), F.sum(wyy).alias("wyy"), F.sum(wxx).alias("wxx"), F.sum(wxy).alias("wxy"), F.avg(1.0 / t).alias("ti"),
        F.var_pop("my").alias("byy"), F.var_pop("mx").alias("bxx"), F.covar_pop("mx", "my").alias("bxy"),
    )
    rss_w = F.col("wyy") - F.col("wxy") * F.col("wxy") / F.col("wxx")
    rss_b = F.col("nf") * (F.col("byy") - F.col("bxy") * F.col("bxy") / F.col("bxx"))
    s2e = rss_w / (F.col("n") - F.col("nf") - 1)
    s2v = F.greatest(F.lit(0.0), rss_b / (F.col("nf") - 2) - s2e * F.col("ti"))
    parts = per.join(F.broadcast(sums.select(s2e.alias("s2e"), s2v.alias("s2v"))))
    theta = 1.0 - F.sqrt(F.col("s2e") / (t * F.col("s2v") + F.col("s2e")))
    c = 1.0 - theta
    total = parts.agg(
        F.first("s2e").alias("sigma2_e"), F.first("s2v").alias("sigma2_v"), F.sum(t * c * c).alias("s11"), F.sum(t * c * c * mx).alias("s1x"), F.sum(t * c * c * my).alias("s1y"),
        F.sum(wxx + t * c * c * mx * mx).alias("sxx"), F.sum(wxy + t * c * c * mx * my).alias("sxy"),
    )
    d = F.col("s11") * F.col("sxx") - F.col("s1x") * F.col("s1x")
    slope = (F.col("s11") * F.col("sxy") - F.col("s1x") * F.col("s1y")) / d
    return total.select("sigma2_e", "sigma2_v", slope.alias("slope"), ((F.col("s1y") - slope * F.col("s1x")) / F.col("s11")).alias("intercept"))


def predicted_random_effects(df: DataFrame, y: str, x: str) -> DataFrame:
    """(id, effect): each id's mean residual of random_effects, shrunk by T s2v / (s2e + T s2v)."""
    means = df.groupBy("id").agg(F.count("*").alias("t"), F.avg(y).alias("my"), F.avg(x).alias("mx")).join(F.broadcast(random_effects(df, y, x)))
    share = F.col("t") * F.col("sigma2_v") / (F.col("sigma2_e") + F.col("t") * F.col("sigma2_v"))
    return means.select("id", (share * (F.col("my") - F.col("intercept") - F.col("slope") * F.col("mx"))).alias("effect"))


def _solved(full: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse of X'X from the sums of products of (X, y)."""
    inverse = np.linalg.pinv(full[:-1, :-1], hermitian=True)
    b = inverse @ full[:-1, -1]
    return b, max(0.0, float(full[-1, -1] - b @ full[:-1, -1])), inverse


def regression(df: DataFrame, y: str, xs: Sequence[str], effect: str = "none") -> DataFrame:
    """(term, estimate, std_error) of y on any number of columns; effect of the id: "none", "fixed" or "random".

    fixed: on deviations from the id's means; its intercept, at the means, has no standard error. random: feasible generalised
    least squares for unbalanced panels, with the variances of random_effects. Each is one or two aggregates over the rows. xs may not be named id.
    """
    if effect not in ("none", "fixed", "random"):
        raise ValueError("effect must be none, fixed or random")
    names = [*xs, y]
    if effect == "none":
        full, n = moments(df, [F.lit(1.0), *map(F.col, names)])
        b, rss, inverse = _solved(full)
        scale = rss / max(1, n - len(b))
    else:
        over = Window.partitionBy("id")
        rows = df.select("id", *names, F.count("*").over(over).alias("_t"), *[F.avg(c).over(over).alias(f"_m_{c}") for c in names])
        # Sums about the grand means, as deviations within ids are small beside the levels.
        centre = df.agg(F.count_distinct("id"), *[F.avg(c) for c in names]).first()
        firms, mean = int(centre[0]), np.array(centre[1:], float)
        inside, n = moments(rows, [F.col(c) - F.col(f"_m_{c}") for c in names])
        b, rss, inverse = _solved(inside)
        scale = rss / max(1, n - firms - len(xs))
        if effect == "fixed":
            b = np.concatenate([[mean[-1] - mean[:-1] @ b], b])
            inverse = np.block([[np.full((1, 1), np.nan), np.zeros((1, len(xs)))], [np.zeros((len(xs), 1)), inverse]])
        else:
            means = df.groupBy("id").agg(F.count("*").alias("_t"), *[F.avg(c).alias(c) for c in names])
            between, _ = moments(means, [F.lit(1.0), *[F.col(c) - float(m) for c, m in zip(names, mean)]])
            shortest = means.agg(F.avg(1.0 / F.col("_t"))).first()[0]
            s2v = max(0.0, _solved(between)[1] / max(1, firms - len(xs) - 1) - scale * shortest)
            share = 1.0 - F.sqrt(scale / (F.col("_t") * s2v + scale)) if scale > 0 else F.lit(1.0)
            full, n = moments(rows, [1.0 - share, *[F.col(c) - float(m) - share * (F.col(f"_m_{c}") - float(m)) for c, m in zip(names, mean)]])
            b, rss, inverse = _solved(full)
            scale = rss / max(1, n - len(b))
            # The intercept back from the grand means.
            move = np.eye(len(b))
            move[0, 1:] = -mean[:-1]
            b, inverse = move @ b + np.eye(len(b))[0] * mean[-1], move @ inverse @ move.T
    se = np.sqrt(scale * np.diag(inverse))
    found = [(t, float(v), None if np.isnan(e) else float(e)) for t, v, e in zip(["_cons", *xs], b, se)]
    return df.sparkSession.createDataFrame(found, "term string, estimate double, std_error double")


def moment_split(df: DataFrame, residual: str, s: int = 1) -> DataFrame:
    """(m2, m3, sigma2_u, sigma2_v) from the second and third central moments of residuals; s = 1 production, -1 cost."""
    r = F.col(residual)
    sums = df.agg(F.count("*").alias("n"), F.sum(r).alias("s1"), F.sum(r * r).alias("s2"), F.sum(r * r * r).alias("s3"))
    n, mean = F.col("n"), F.col("s1") / F.col("n")
    m2 = F.col("s2") / n - mean * mean
    m3 = F.col("s3") / n - 3 * mean * F.col("s2") / n + 2 * mean * mean * mean
    m3 = F.when(s * m3 >= 0, F.lit(-1e-4 * s)).otherwise(m3)
    scale = math.sqrt(2 / math.pi) * (1 - 4 / math.pi)
    su = F.pow((s * m3 / scale) * (s * m3 / scale), 1.0 / 3.0)
    sv = m2 - (1 - 2 / math.pi) * su
    positive = lambda c: F.when(c > 0, c).otherwise(0.1)
    return sums.select(m2.alias("m2"), m3.alias("m3"), positive(su).alias("sigma2_u"), positive(sv).alias("sigma2_v"))
