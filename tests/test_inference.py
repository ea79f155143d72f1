"""Formulas against columns made by hand; tests, searches and bootstrap on panels with known parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import formula, inference
from fathomline.operators import frontier as fr
from fathomline.operators.regression import ols


def test_design_columns(spark):
    rows = [(1, 2.0, 3.0, "a"), (2, 5.0, 0.5, "b"), (3, None, 1.0, "c"), (4, 1.0, -1.0, "b"), (5, float("inf"), 1.0, "a")]
    df = spark.createDataFrame(rows, "id int, x double, z double, g string").withColumn("y", F.col("id") * 1.0)
    out = formula.design(df, "y ~ x * z + C(g) + C(g):x", ["id"])
    assert out.columns == ["id", "y", "_cons", "x", "z", "g[b]", "x:z", "g[b]:x"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 1.0, 1.0, 2.0, 3.0, 0.0, 6.0, 0.0), (2, 2.0, 1.0, 5.0, 0.5, 1.0, 2.5, 5.0), (4, 4.0, 1.0, 1.0, -1.0, 1.0, -1.0, 1.0)]
    assert formula.design(df, "log(y) ~ - 1 + log(z)").columns == ["log(y)", "log(z)"]
    assert formula.design(df, "log(y) ~ log(z)").count() == 4
    with pytest.raises(ValueError, match="formula"):
        formula.Formula.of("y")
    with pytest.raises(ValueError, match="levels"):
        formula.levels(spark.range(20), "id", 10)


def test_likelihood_ratio():
    assert inference.likelihood_ratio((-100.0, 3), (-98.0, 4)) == (4.0, 1, pytest.approx(math.erfc(math.sqrt(2)), rel=1e-9))
    assert inference.likelihood_ratio((-98.0, 5), (-100.0, 3))[2] == pytest.approx(math.exp(-2), rel=1e-9)
    assert inference.likelihood_ratio((-100.0, 3), (-101.0, 6))[0] == 0
    with pytest.raises(ValueError):
        inference.likelihood_ratio((-1.0, 2), (-2.0, 2))


LOG_S2 = {"uit": 2 * math.log(0.4), "vit": 2 * math.log(0.2), "vi0": 2 * math.log(0.2)}


def test_search_finds_what_a_fit_finds(spark):
    panel = fr.simulated_panel(spark, 80, 5, [1.0, 0.5], LOG_S2, seed=2)
    model = fr.Frontier("y", ["x1"], effect="quadrature", nodes=10)
    fits, starts = inference.search(panel, model, starts=12, fits=2)
    assert len(fits) == 2 and fits[0].converged and starts.count() == 12
    assert fits[0].loglik == pytest.approx(fr.fit(panel, model).loglik, abs=1e-4)
    assert fits[0].loglik >= starts.agg(F.max("loglik")).first()[0]


def test_pseudo_sample_and_bootstrap(spark):
    base = fr.simulated_panel(spark, 150, 4, [1.0, 0.5], LOG_S2, seed=5).withColumn("z", F.col("x1") * 0.5 + F.randn(4))
    model = fr.Frontier("y", ["x1"], zuit=["z"], effect="quadrature", nodes=7)
    theta = np.array([1.0, 0.5, 2 * math.log(0.4), 0.6, 2 * math.log(0.2), 2 * math.log(0.2)])
    drawn = inference.pseudo_sample(base, theta, model, 3)
    assert drawn.select("id", "y").exceptAll(inference.pseudo_sample(base.repartition(3), theta, model, 3).select("id", "y")).isEmpty()
    assert abs(ols(drawn, "y", ["x1"])[1] - 0.5) < 0.1
    fitted = fr.fit(drawn, model)
    assert fitted.converged and np.allclose(fitted.theta[[1, 3]], [0.5, 0.6], atol=0.25)
    (row,) = inference.bootstrap_effects(drawn, fitted, model, reps=6).collect()
    assert row.term == "Zuit_z" and row.low <= row.high and row.low < row.effect * 1.5 and row.high > row.effect * 0.5
