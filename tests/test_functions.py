"""Special functions against the standard library, and panel operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import normal, special
from fathomline.operators import density, panel

X = [-8.0, -3.2, -1.0, -1e-3, 0.0, 0.4, 1.9, 5.0]


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def test_normal_distribution_function(spark):
    mine = [r[0] for r in spark.createDataFrame([(x,) for x in X], "x double").select(normal.norm_cdf(F.col("x"))).collect()]
    assert np.allclose(sorted(mine), sorted(map(phi, X)), rtol=1e-6, atol=1e-15)
    assert np.allclose(special.ndtr(np.array(X)), list(map(phi, X)), rtol=1e-6, atol=1e-15)


def test_quantiles_invert():
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.8, 0.999])
    assert np.allclose(special.ndtr(special.ndtri(p)), p, rtol=1e-6)
    assert special.t_sf(special.t_quantile(0.975, 7), 7) == pytest.approx(0.025, rel=1e-6)
    assert special.t_quantile(0.975, 7) == pytest.approx(2.364624, rel=1e-6)
    assert special.chi2_sf(2.0, 2) == pytest.approx(math.exp(-1), rel=1e-9)


def test_half_normal_density_integrates_to_one(spark):
    s2u, s2v = 0.3, 0.2
    e = spark.range(4001).select((F.col("id") / 200.0 - 10).alias("e"))
    total = e.select(F.exp(density.log_density_hn(F.col("e"), F.lit(s2u), F.lit(s2v))).alias("f")).agg(F.sum("f") / 200).first()[0]
    assert total == pytest.approx(1, abs=1e-6)


def test_complete_cases_drop_null_nan_and_infinite(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, 2.0)], "id int, y double")
    assert sorted(r[0] for r in panel.complete_cases(df, ["y"]).collect()) == [1, 5]


def test_within_removes_firm_means(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 1, 5.0)], "id int, time int, x double")
    out = panel.within(df, ["x"])
    assert sorted(tuple(r) for r in out.select("id", "time", "x_w").collect()) == [(1, 1, -1.0), (1, 2, 1.0), (2, 1, 0.0)]
