"""Hessians against differences, quadrature against dense integration, latent classes against known ones, orthants against plain sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions.special import ndtr
from fathomline.operators import colombi, mixture
from fathomline.operators import frontier as fr

LOG_S2 = {"uit": 2 * math.log(0.3), "vit": 2 * math.log(0.2), "vi0": 2 * math.log(0.15)}


@pytest.fixture(scope="module")
def panel(spark):
    return fr.simulated_panel(spark, 40, 5, [1.0, 0.5, 0.3], LOG_S2, seed=42).filter("not (id = 3 and time > 2)").withColumn("z", (F.col("id") % 3).cast("double")).cache()


MODELS = {
    "tre": fr.Frontier("y", ["x1", "x2"], zuit=["x1"], zvi0=["z"], draws=12),
    "gtre": fr.Frontier("y", ["x1"], zvit=["x2"], zui0=["z"], persistent=True, s=-1, draws=9, scrambled=True),
    "quadrature": fr.Frontier("y", ["x1", "x2"], effect="quadrature", nodes=20),
    "cross": fr.Frontier("y", ["x1", "x2"], zuit=["x2"], effect="none"),
    "classes": mixture.Mixture(fr.Frontier("y", ["x1"], effect="quadrature", nodes=20), 3, ["z"]),
    "classes of rows": mixture.Mixture(fr.Frontier("y", ["x1"], effect="none"), 2, ["x2"]),
}


@pytest.mark.parametrize("name", MODELS)
def test_gradient_and_hessian_equal_differences(panel, name):
    model = MODELS[name]
    rows = fr.prepared(panel, model).cache()
    p = len(model.terms())
    theta = np.random.default_rng(3).normal(0, 0.3, p) + np.array([-1.5 if "_Z" in t and "Zsp" not in t or t.startswith("Z") and t.endswith("cons") else 0.6 for t in model.terms()])
    (here,) = fr.evaluate(rows, [theta], model, curved=True)
    (plain,) = fr.evaluate(rows, [theta], model)
    assert here.loglik == pytest.approx(plain.loglik, rel=1e-9) and np.allclose(here.gradient, plain.gradient, rtol=1e-7, atol=1e-7)
    shifts = 1e-4 * np.eye(p)
    found = fr.evaluate(rows, [*(theta + d for d in shifts), *(theta - d for d in shifts)], model)
    numeric = np.array([(a.loglik - b.loglik) / 2e-4 for a, b in zip(found, found[p:])])
    assert np.allclose(here.gradient, numeric, rtol=2e-3, atol=2e-2)
    bend = np.array([(a.gradient - b.gradient) / 2e-4 for a, b in zip(found, found[p:])])
    assert np.allclose(here.hessian, bend, rtol=2e-3, atol=3e-2 * np.abs(bend).max() / 10)
    assert here.hessian == pytest.approx(here.hessian.T)


def test_quadrature_equals_dense_integration(panel):
    model = fr.Frontier("y", ["x1", "x2"], effect="quadrature", nodes=15)
    rows = fr.prepared(panel, model)
    theta = np.array([1.2, 0.5, 0.3, -2.2, -3.0, -2.5])
    part, total = model.split(theta), 0.0
    grid = np.linspace(-9, 9, 6001)
    pdf = rows.toPandas()
    for _, firm in pdf.groupby("rank"):
        e = firm["y"].to_numpy() - np.stack(firm["x"]) @ part["x"]
        log_f, _ = fr.log_half_normal(e[:, None] - math.exp(0.5 * part["zvi0"][0]) * grid, np.exp(part["zuit"][0]), np.exp(part["zvit"][0]), 1)
        total += math.log(np.trapezoid(np.exp(log_f.sum(0) - 0.5 * grid**2) / math.sqrt(2 * math.pi), grid))
    assert fr.evaluate(rows, [theta], model)[0].loglik == pytest.approx(total, abs=1e-6)


def test_one_class_twice_is_no_better_than_one(panel):
    """Two classes with the same parameters have the likelihood of one."""
    single = fr.Frontier("y", ["x1", "x2"], effect="quadrature")
    double = mixture.Mixture(single, 2)
    theta = np.array([1.2, 0.5, 0.3, -2.2, -3.0, -2.5])
    one = fr.evaluate(fr.prepared(panel, single), [theta], single)[0]
    two = fr.evaluate(fr.prepared(panel, double), [np.concatenate([[0.7], theta, theta])], double)[0]
    assert two.loglik == pytest.approx(one.loglik, rel=1e-10)


def test_two_classes_are_told_apart(spark):
    a = fr.simulated_panel(spark, 80, 6, [1.0, 0.9], LOG_S2, seed=1)
    b = fr.simulated_panel(spark, 80, 6, [2.5, -0.4], LOG_S2, seed=50).withColumn("id", F.col("id") + 1000)
    both = a.union(b).cache()
    model = mixture.Mixture(fr.Frontier("y", ["x1"], effect="quadrature", nodes=7), 2)
    found = mixture.fit(both, model)
    assert found.converged and found.n_firms == 160
    slopes = sorted(t[1] for t in model.parts(found.theta)[1])
    assert np.allclose(slopes, [-0.4, 0.9], atol=0.08)
    post = mixture.posteriors(both, found.theta, model).cache()
    assert post.groupBy("id", "time").agg(F.sum("posterior").alias("s"), F.sum("prior").alias("p")).filter("abs(s - 1) > 1e-9 or abs(p - 1) > 1e-9").isEmpty()
    mine = post.filter("posterior > 0.5").select("id", "class").distinct().groupBy((F.col("id") > 1000).alias("b"), "class").count().collect()
    assert sum(r["count"] for r in mine) >= 158 and sum(sorted(r["count"] for r in mine)[-2:]) >= 156
    scores = mixture.efficiencies(both, found.theta, model)
    assert scores.count() == 960 and scores.filter("efficiency <= 0 or efficiency > 1").isEmpty()
    em = mixture.fit(both, model, start=found.theta + 0.02, most_steps=60, em=True)
    assert em.loglik == pytest.approx(found.loglik, abs=1e-2)


def test_cross_section_fit(spark):
    rows = fr.simulated_panel(spark, 3000, 1, [1.0, 0.5, 0.3], {"uit": 2 * math.log(0.4), "vit": 2 * math.log(0.2), "vi0": -40.0}, seed=3)
    model = fr.Frontier("y", ["x1", "x2"], effect="none")
    found = fr.fit(rows, model)
    assert found.converged and np.linalg.norm(found.gradient) < 1e-4 and found.n_firms == 3000
    assert np.allclose(found.theta[:3], [1.0, 0.5, 0.3], atol=0.06) and np.allclose(np.exp(0.5 * found.theta[3:]), [0.4, 0.2], atol=0.06)
    table = found.table(spark).toPandas()
    assert (table["low"] < table["estimate"]).all() and (table["estimate"] < table["high"]).all()
    classes = mixture.Mixture(model, 2)
    assert mixture.fit(rows.limit(300), classes, most_steps=5).loglik >= fr.fit(rows.limit(300), model, most_steps=0).loglik - 5


def test_determinants_of_firm_effects_may_not_vary(panel):
    with pytest.raises(ValueError, match="constant"):
        fr.fit(panel, fr.Frontier("y", ["x1"], zvi0=["x2"], draws=4))


def test_orthant_probability_of_two_dimensions():
    uniform = colombi.uniform_draws(2, 20_000)
    for rho, mean in ((0.5, (0.3, -0.4)), (-0.7, (1.0, 0.2))):
        grid = np.linspace(-8, 8, 200_001)
        density = np.exp(-0.5 * grid**2) / math.sqrt(2 * math.pi)
        inner = ndtr((mean[1] + rho * grid) / math.sqrt(1 - rho**2))
        wanted = np.trapezoid(np.where(mean[0] + grid > 0, density * inner, 0), grid)
        found = colombi.log_orthant(np.array(mean), np.linalg.cholesky(np.array([[1, rho], [rho, 1]])), uniform)
        assert math.exp(found) == pytest.approx(wanted, rel=2e-3)


def test_efficiencies_of_one_period_equal_the_closed_form():
    """With one period and hardly any persistent inefficiency the transient one is Battese and Coelli's, and the noises add up."""
    uniform = colombi.uniform_draws(2, 4000)
    for r in (-0.5, 0.1, 0.6):
        s2u, s2v, s2v0 = 0.09, 0.03, 0.02
        noise = s2v + s2v0
        mu, sd = -r * s2u / (s2u + noise), math.sqrt(s2u * noise / (s2u + noise))
        wanted = math.exp(-mu + 0.5 * sd * sd) * ndtr(np.array(mu / sd - sd)) / ndtr(np.array(mu / sd))
        found = colombi.firm_efficiencies(np.array([r]), 0.0, s2v0, np.array([s2u]), np.array([s2v]), 1, uniform)
        assert found[1] == pytest.approx(float(wanted), rel=1e-3) and found[0] == pytest.approx(1, abs=1e-4)


def test_four_component_efficiencies_follow_the_truth(spark):
    truth = fr.simulated_panel(spark, 60, 6, [1.0, 0.5], LOG_S2 | {"ui0": 2 * math.log(0.5)}, seed=9)
    model = fr.Frontier("y", ["x1"], persistent=True, draws=50)
    theta = np.array([1.0, 0.5, LOG_S2["uit"], LOG_S2["vit"], LOG_S2["vi0"], 2 * math.log(0.5)])
    out = colombi.efficiencies(truth, theta, model, draws=300).join(truth, ["id", "time"])
    assert out.count() == 360 and out.filter("persistent < 0 or persistent > 1 or transient < 0 or transient > 1").isEmpty()
    row = out.agg(F.corr("transient", F.exp(-F.col("uit_true"))), F.corr("persistent", F.exp(-F.col("ui0_true")))).first()
    assert row[0] > 0.5 and row[1] > 0.7
