"""Sums over draws by way of a few nodes, against the sums over the draws one by one; and how often a fit reads its panel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import special
from fathomline.operators import frontier as fr

LOG_S2 = {"uit": 2 * math.log(0.3), "vit": 2 * math.log(0.2), "vi0": 2 * math.log(0.15)}


def block(firms, seed=5):
    """Firms of one to six rows, with a determinant of the inefficiency."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 7, firms)
    n = int(sizes.sum())
    x, one = rng.normal(size=n), np.ones((n, 1))
    y = 1 + 0.5 * x + np.repeat(0.15 * rng.normal(size=firms), sizes) + 0.2 * rng.normal(size=n) - 0.3 * np.abs(rng.normal(size=n))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return {"rank": np.repeat(np.arange(1, firms + 1), sizes), "y": y, "x": np.column_stack([one, x]), "zuit": np.column_stack([one, x]), "zvit": one, "zvi0": one, "mu": one, "starts": starts}


@pytest.mark.parametrize("law", ["half", "truncated"])
@pytest.mark.parametrize("effect", [-25.0, -6.0, -3.8])
@pytest.mark.parametrize("shuffled", [False, True])
def test_nodes_stand_for_all_draws(law, effect, shuffled, monkeypatch):
    model = fr.Frontier("y", ["x1"], zuit=["x1"], distribution=law, mu=[], shuffled=shuffled)
    rows = block(40) | {"firms": np.array([40.0])}
    theta = np.array([1.0, 0.5, -2.4, 0.1, -3.2, *([0.1] if law == "truncated" else []), effect])
    few = fr.Paths(rows, theta, model, {})
    assert few.by_draw.shape[1] <= model.draws // 4 and np.allclose(few.by_draw.sum(axis=1), 1)
    loglik, score, hessian = fr.firm_curvature(rows, theta, model)
    alone, scores, spent = model.value(rows, theta, {}), fr.firm_scores(rows, theta, model)[1], few.inefficiency()
    monkeypatch.setattr(fr, "LEAST_TERMS", model.draws)
    every = fr.Paths(rows, theta, model, {})
    assert every.by_draw.shape[1] == model.draws
    wanted = fr.firm_curvature(rows, theta, model)
    for found in (loglik, alone):
        assert np.allclose(found, wanted[0], rtol=1e-9, atol=1e-9)
    for found in (score, scores):
        assert np.allclose(found, wanted[1], rtol=1e-8, atol=1e-8)
    assert np.allclose(hessian, wanted[2], rtol=1e-8, atol=1e-7)
    for found, plain in zip(spent, every.inefficiency()):
        assert np.allclose(found, plain, rtol=1e-7)


def test_draws_that_no_short_series_has_are_summed_one_by_one():
    model = fr.Frontier("y", ["x1"], zuit=["x1"], draws=40)
    paths = fr.Paths(block(10), np.array([1.0, 0.5, -1.0, 0.1, -8.0, 2.0]), model, {})
    assert paths.by_draw.shape[1] == 40 and np.isfinite(paths.loglik).all()


def test_smooth_normal_law():
    x = np.array([-36.0, -20.0, -8.0, -7.08, -7.07, -5.0, -1.3, -1e-9, 0.0, 0.4, 3.0, 9.0])
    wanted = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in x])
    log_phi, mills = special.log_ndtr_mills(x)
    assert np.allclose(log_phi, wanted, rtol=1e-12, atol=1e-18)
    assert np.allclose(mills, np.exp(special.log_pdf(x) - wanted), rtol=1e-10)


@pytest.mark.parametrize("base", [2, 3, 7])
@pytest.mark.parametrize("scrambled", [False, True])
def test_digits_looked_up_several_at_a_time(base, scrambled):
    digits = np.random.default_rng(base).permutation(base) if scrambled else np.arange(base)
    places = np.array([1, base, 4095, 4096, 4097, 10**6 + 1, 2**40 + 3])
    count = max(k for k in range(60) if float(base) ** -k > 1e-16)
    wanted = [sum(int(digits[n // base**k % base]) * float(base) ** -(k + 1) for k in range(count)) for n in map(int, places)]
    assert np.allclose(fr.halton(places, base, digits if scrambled else None), wanted, rtol=0, atol=1e-15)


def test_a_fit_reads_its_panel_once(spark):
    panel, read = fr.simulated_panel(spark, 40, 4, [1.0, 0.5], LOG_S2, seed=3), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = fr.fit(panel.select("id", "time", "y", "x1").mapInArrow(counted, "id long, time int, y double, x1 double"), fr.Frontier("y", ["x1"], draws=50), most_steps=1)
    assert found.n_obs == read.value == 160
    plain = fr.fit(panel.withColumn("other", F.lit(None).cast("double")), fr.Frontier("y", ["x1"], draws=50), most_steps=1)
    assert plain.loglik == pytest.approx(found.loglik, rel=1e-12)
