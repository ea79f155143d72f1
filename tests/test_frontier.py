"""Simulated maximum likelihood: a plain loop as brute force, numeric derivatives, and recovery of known parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import frontier as fr

LOG_S2 = {"uit": 2 * math.log(0.3), "vit": 2 * math.log(0.2), "vi0": 2 * math.log(0.15)}


@pytest.fixture(scope="module")
def panel(spark):
    return fr.simulated_panel(spark, 50, 5, [1.0, 0.5, 0.3], LOG_S2, seed=42).cache()


def plain_loglik(rows, theta, model):
    """One firm and draw after the other, with the standard library's normal distribution."""
    part, total = model.split(theta), 0.0
    firms = {}
    for r in rows:
        firms.setdefault(r["rank"], []).append(r)
    for rank, mine in firms.items():
        draws = [fr.normal_draws(np.array([rank]), model, b)[0] for b in model.bases]
        paths = []
        for k in range(model.draws):
            log_f = 0.0
            for r in mine:
                e = r["y"] - np.dot(r["x"], part["x"]) - math.exp(0.5 * np.dot(r["zvi0"], part["zvi0"])) * draws[0][k]
                if model.persistent:
                    e += model.s * math.exp(0.5 * np.dot(r["zui0"], part["zui0"])) * abs(draws[1][k])
                su, sv = math.exp(0.5 * np.dot(r["zuit"], part["zuit"])), math.exp(0.5 * np.dot(r["zvit"], part["zvit"]))
                sigma = math.hypot(su, sv)
                log_f += math.log(2 / sigma) - 0.5 * math.log(2 * math.pi) - 0.5 * (e / sigma) ** 2 + math.log(0.5 * math.erfc(model.s * e * su / sv / sigma / math.sqrt(2)))
            paths.append(log_f)
        total += math.log(np.mean(np.exp(paths)))
    return total


@pytest.mark.parametrize("s", [1, -1])
@pytest.mark.parametrize("persistent", [False, True])
def test_likelihood_and_gradient(panel, s, persistent, monkeypatch):
    monkeypatch.setattr(fr, "BLOCK_CELLS", 60)
    model = fr.Frontier("y", ["x1", "x2"], zuit=["x1"], zvi0=[], persistent=persistent, s=s, draws=6)
    rows = fr.prepared(panel.filter("id <= 9 and not (id = 3 and time > 2)"), model).cache()
    theta = np.array([1.0, 0.5, 0.3, -2.0, 0.2, -3.0, -3.5] + [-3.0] * persistent)
    here = fr.evaluate(rows, [theta], model)[0]
    assert here.loglik == pytest.approx(plain_loglik(rows.collect(), theta, model), rel=1e-6)
    shifts = 1e-5 * np.eye(len(theta))
    found = fr.evaluate(rows, [*(theta + d for d in shifts), *(theta - d for d in shifts)], model)
    numeric = [(a.loglik - b.loglik) / 2e-5 for a, b in zip(found, found[len(theta) :])]
    assert np.allclose(here.gradient, numeric, rtol=1e-3, atol=1e-3)


def test_fit_recovers_the_parameters(spark):
    big = fr.simulated_panel(spark, 300, 6, [1.0, 0.5, 0.3], LOG_S2, seed=7)
    model = fr.Frontier("y", ["x1", "x2"], draws=100)
    found = fr.fit(big, model)
    assert found.converged and found.n_obs == 1800 and found.n_firms == 300
    assert np.allclose(found.theta[:3], [1.0, 0.5, 0.3], atol=0.08)
    assert np.allclose(np.exp(0.5 * found.theta[3:]), [0.3, 0.2, 0.15], atol=0.08)
    table = found.table(spark).toPandas()
    assert list(table["term"]) == ["_cons", "x1", "x2", "Zuit_cons", "Zvit_cons", "Zvi0_cons"] and (table["std_error"] > 0).all()
    scores = fr.efficiencies(big, found.theta, model).join(big, ["id", "time"])
    assert scores.count() == 1800 and scores.filter("efficiency <= 0 or efficiency > 1 or inefficiency < 0").isEmpty()
    assert scores.agg(F.corr("inefficiency", "uit_true")).first()[0] > 0.5


def test_incomplete_rows_and_wrong_arguments(spark, panel):
    model = fr.Frontier("y", ["x1"], draws=4)
    odd = panel.withColumn("x1", F.when(F.col("time") == 1, F.lit(float("inf"))).when(F.col("time") == 2, F.lit(None)).otherwise(F.col("x1")))
    assert fr.prepared(odd, model).count() == 150
    with pytest.raises(ValueError, match="no complete rows"):
        fr.fit(panel.filter("false"), model)
    with pytest.raises(ValueError, match="start"):
        fr.fit(panel, model, start=np.zeros(2))
    with pytest.raises(ValueError, match="bases"):
        fr.Frontier("y", ["x1"], bases=(2, 2))
