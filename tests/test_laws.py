"""Truncated-normal inefficiency and fixed firm effects: dense integration, differences, plain search, and recovery."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import frontier as fr
from fathomline.operators import mixture

LOG_S2 = {"uit": 2 * math.log(0.3), "vit": 2 * math.log(0.2), "vi0": 2 * math.log(0.3)}


@pytest.fixture(scope="module")
def panel(spark):
    return fr.simulated_panel(spark, 60, 12, [1.0, 0.5, 0.3], LOG_S2, seed=7).cache()


@pytest.mark.parametrize("s", [1, -1])
@pytest.mark.parametrize("mu", [-0.4, 0.0, 0.3])
def test_truncated_density_is_the_integral_over_u(s, mu):
    su, sv = 0.3, 0.2
    u = np.linspace(0, 6, 600_001)
    cut = np.exp(-0.5 * ((u - mu) / su) ** 2)
    cut /= np.trapezoid(cut, u)
    for e in (-1.0, -0.2, 0.1, 0.6):
        f = np.trapezoid(cut * np.exp(-0.5 * ((e + s * u) / sv) ** 2) / (sv * math.sqrt(2 * math.pi)), u)
        found = fr.log_truncated_normal(np.array([e]), np.array([mu]), np.array([su**2]), np.array([sv**2]), s)[0][0]
        assert found == pytest.approx(math.log(f), abs=1e-6)


CASES = [("truncated", e) for e in ("none", "halton", "quadrature", "fixed")] + [("half", "fixed")]


@pytest.mark.parametrize("s", [1, -1])
@pytest.mark.parametrize("distribution, effect", CASES)
def test_score_and_hessian_are_the_differences(panel, distribution, effect, s):
    truncated = distribution == "truncated"
    model = fr.Frontier("y", ["x1", "x2"], zuit=["x1"], effect=effect, s=s, draws=8, distribution=distribution, mu=["x2"] if truncated else [])
    rows = fr.prepared(panel.filter("id <= 9 and not (id = 3 and time > 2)"), model).coalesce(2).cache()
    part = {"x": [1.0, 0.5, 0.3][effect == "fixed" :], "zuit": [-2.4, 0.2], "zvit": [-3.2], "mu": [0.2, -0.1], "zvi0": [-2.5]}
    theta = np.concatenate([part[b] for b in model.blocks()])
    assert len(theta) == len(model.terms())
    step = 1e-5
    moved = [theta + d * step * row for row in np.eye(len(theta)) for d in (1, -1)]
    here, *around = fr.evaluate(rows, [theta, *moved], model)
    (curved,) = fr.evaluate(rows, [theta], model, curved=True)
    slope = [(a.loglik - b.loglik) / (2 * step) for a, b in zip(around[::2], around[1::2])]
    bend = np.array([(a.gradient - b.gradient) / (2 * step) for a, b in zip(around[::2], around[1::2])])
    # The adaptive nodes move with the parameters, which the derivatives leave out.
    loose = 1e-2 if effect == "quadrature" else 1e-4
    assert here.gradient == pytest.approx(np.array(slope), rel=loose, abs=loose)
    assert curved.loglik == pytest.approx(here.loglik)
    assert curved.hessian == pytest.approx(bend, rel=10 * loose, abs=10 * loose)


def test_truncated_with_a_mean_of_zero_is_half_normal(panel):
    half = fr.Frontier("y", ["x1"], effect="none")
    cut = fr.Frontier("y", ["x1"], effect="none", distribution="truncated")
    theta = np.array([1.2, 0.5, -2.4, -3.2])
    a, b = fr.evaluate(fr.prepared(panel, half), [theta], half)[0], fr.evaluate(fr.prepared(panel, cut), [np.append(theta, 0.0)], cut)[0]
    assert a.loglik == pytest.approx(b.loglik)
    u, v = (fr.efficiencies(panel, t, m).orderBy("id", "time").toPandas() for t, m in ((theta, half), (np.append(theta, 0.0), cut)))
    assert u["efficiency"].to_numpy() == pytest.approx(v["efficiency"].to_numpy())


def test_truncated_mean_is_found(spark):
    # u is normal about 0.8 and hardly cut, so its mean and the intercept are told apart by the determinant of the mean.
    rows = spark.range(4000).select(F.col("id"), F.randn(1).alias("x"), (F.rand(2) > 0.5).cast("double").alias("z"), F.randn(3).alias("v"), F.randn(4).alias("w"))
    u = F.greatest(F.lit(0.0), 0.3 + 0.8 * F.col("z") + 0.3 * F.col("w"))
    rows = rows.filter(0.3 + 0.8 * F.col("z") + 0.3 * F.col("w") > 0).withColumn("y", 1 + 0.5 * F.col("x") + 0.1 * F.col("v") - u)
    found = fr.fit(rows, fr.Frontier("y", ["x"], effect="none", distribution="truncated", mu=["z"]))
    at = dict(zip(found.terms, found.theta))
    assert found.converged
    assert at["x"] == pytest.approx(0.5, abs=0.02) and at["Mu_z"] == pytest.approx(0.8, abs=0.12) and at["_cons"] == pytest.approx(1.0, abs=0.15)


def test_fixed_effects_are_the_likeliest(panel):
    model = fr.Frontier("y", ["x1", "x2"], effect="fixed")
    theta, few = np.array([0.5, 0.3, -2.4, -3.2]), panel.filter("id in (2, 5)")
    found = {r["id"]: r["effect"] for r in fr.fixed_effects(few, theta, model).collect()}
    grid = np.linspace(-3, 5, 800_001)
    for i in (2, 5):
        total = np.zeros(len(grid))
        for r in few.filter(F.col("id") == i).collect():
            e = r["y"] - 0.5 * r["x1"] - 0.3 * r["x2"] - grid
            total += fr.log_half_normal(e, np.exp(-2.4), np.exp(-3.2), 1)[0]
        assert found[i] == pytest.approx(grid[total.argmax()], abs=2e-5)


def test_fixed_effects_fit(panel):
    model = fr.Frontier("y", ["x1", "x2"], effect="fixed")
    found = fr.fit(panel, model)
    at = dict(zip(found.terms, found.theta))
    assert found.converged and list(at) == model.terms() == ["x1", "x2", "Zuit_cons", "Zvit_cons"]
    assert at["x1"] == pytest.approx(0.5, abs=0.06) and at["x2"] == pytest.approx(0.3, abs=0.06)
    assert found.n_parameters == 60 + 4 and found.aic() == pytest.approx(2 * 64 - 2 * found.loglik)
    # The effects follow the true ones, and the efficiencies the true inefficiencies.
    effects = fr.fixed_effects(panel, found.theta, model).join(panel.select("id", "vi0_true").distinct(), "id")
    assert effects.agg(F.corr("effect", "vi0_true")).first()[0] > 0.8
    scores = fr.efficiencies(panel, found.theta, model).join(panel, ["id", "time"])
    assert scores.count() == 720 and scores.agg(F.corr("inefficiency", "uit_true")).first()[0] > 0.3


def test_settings_that_exclude_each_other():
    for wrong in ({"effect": "fixed", "persistent": True}, {"mu": ["a"]}, {"distribution": "gamma"}, {"effect": "other"}):
        with pytest.raises(ValueError):
            fr.Frontier("y", ["x"], **wrong)
    with pytest.raises(ValueError):
        mixture.Mixture(fr.Frontier("y", ["x"], effect="fixed"))
