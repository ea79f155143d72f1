"""Searches on known functions, and many fits in lockstep: likelihoods, bootstraps, classes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import colombi, formula, inference, kmeans, mixture, optimise
from fathomline.operators import frontier as fr
from fathomline.operators import panel as pn
from fathomline.operators.optimise import CURVED, GRADIENT, Ask, Options, Sums

LOG_S2 = {"uit": 2 * math.log(0.4), "vit": 2 * math.log(0.2), "vi0": 2 * math.log(0.2)}


def rosenbrock(asks):
    """Minus the valley with its top at (1, 1, 1), with gradient and Hessian."""
    out = []
    for a in asks:
        x = a.theta
        d = x[1:] - x[:-1] ** 2
        g, h = np.zeros(len(x)), np.zeros((len(x),) * 2)
        for k in range(len(x) - 1):
            g[k] += -400 * x[k] * d[k] - 2 * (1 - x[k])
            g[k + 1] += 200 * d[k]
            h[k, k] += 1200 * x[k] ** 2 - 400 * x[k + 1] + 2
            h[k + 1, k + 1] += 200
            h[k, k + 1] = h[k + 1, k] = -400 * x[k]
        value = -float((100 * d**2).sum() + ((1 - x[:-1]) ** 2).sum())
        out.append(Sums(value, -g if a.level >= GRADIENT else None, np.eye(len(x)) if a.level >= CURVED else None, -h if a.level == CURVED else None, -h if a.level == CURVED else None))
    return out


@pytest.mark.parametrize("method", [*optimise.METHODS, "hybrid_lbfgs_tr", None])
def test_methods_reach_the_top(method):
    (found,) = optimise.lockstep([optimise.search(method, np.array([-1.2, 1.0, 0.4]), Options(grad_err_tol=1e-6))], rosenbrock)
    assert found.converged and found.reason == "gradient" and np.allclose(found.theta, 1, atol=1e-5) and found.here.hessian is not None


def test_lockstep_shares_jobs():
    jobs = []
    count = lambda asks: (jobs.append(len(asks)), rosenbrock(asks))[1]
    starts = [np.array([-1.2, 1.0]), np.array([1.0, 1.0]), np.array([0.5, 0.2]), np.array([3.0, -2.0])]
    together = optimise.lockstep([optimise.search("lbfgs", t, Options()) for t in starts], count)
    all_jobs, alone = len(jobs), []
    for t in starts:
        jobs.clear()
        (one,) = optimise.lockstep([optimise.search("lbfgs", t, Options())], count)
        alone.append((len(jobs), one.theta))
    assert all_jobs == max(n for n, _ in alone) and all(np.array_equal(f.theta, t) for f, (_, t) in zip(together, alone))


def test_wolfe_conditions():
    options, theta = Options(), np.array([-1.2, 1.0, 0.4])
    (here,) = rosenbrock([Ask(theta, GRADIENT)])
    for first in (1e-4, 0.1, 5.0):
        search = optimise.wolfe(theta, here, here.gradient, first, options)
        asks = next(search)
        try:
            while True:
                asks = search.send(rosenbrock(asks))
        except StopIteration as end:
            at, value, slope, _ = end.value
        start = -here.gradient @ here.gradient
        assert value <= -here.loglik + options.wolfe_cons_1 * at * start and abs(slope) <= -options.wolfe_cons_2 * start


def test_swarm_leaves_a_bad_valley():
    """A function whose gradient leads away from its top, and which isn't finite in places."""

    def evaluate(asks):
        out = []
        for a in asks:
            x = a.theta
            value = math.nan if x[0] < -1.5 else float(5 * np.exp(-4 * ((x - 1.5) ** 2).sum()) + np.exp(-0.2 * ((x + 1) ** 2).sum()))
            g = -40 * (x - 1.5) * np.exp(-4 * ((x - 1.5) ** 2).sum()) - 0.4 * (x + 1) * np.exp(-0.2 * ((x + 1) ** 2).sum())
            out.append(Sums(value, g, np.eye(2), -np.eye(2), -np.eye(2)))
        return out

    start = np.array([-1.0, -0.9])
    for topology in ("global", "ring", "von_neumann", "graph", "dynamic"):
        (found,) = optimise.lockstep([optimise.swarm(start, 3.0, 120, topology=topology, seed=4)], evaluate)
        assert np.allclose(found.theta, 1.5, atol=0.1), topology
    (alone,) = optimise.lockstep([optimise.search("tr", start, Options())], evaluate)
    assert alone.theta[0] < 0
    with pytest.raises(ValueError):
        optimise.neighbours("star", 4, np.random.default_rng(1))
    assert optimise.neighbours("von_neumann", 40, None).sum(axis=1).max() == 5 and optimise.neighbours("ring", 6, None).sum() == 18


def test_options():
    assert Options.of({"maxit": 3, "em_tol": 0.1}).maxit == 3
    for bad in ({"max_it": 3}, {"tr_radius": 0.0}, {"wolfe_cons_1": -1}):
        with pytest.raises(ValueError):
            Options.of(bad)


@pytest.fixture(scope="module")
def panel(spark):
    return fr.simulated_panel(spark, 60, 5, [1.0, 0.5], LOG_S2, seed=2).withColumn("z", (F.col("id") % 3).cast("double")).filter("not (id = 4 and time > 2)").cache()


def test_quasi_newton_equals_newton(panel):
    model = fr.Frontier("y", ["x1"], draws=20)
    newton, quasi = fr.fit(panel, model), fr.fit(panel, model, method="lbfgs")
    assert newton.converged and quasi.converged and np.allclose(newton.theta, quasi.theta, atol=1e-4) and np.allclose(newton.vcov(), quasi.vcov(), atol=1e-5)
    assert newton.reason == "gradient" and fr.fit(panel, model, options={"maxit": 1}).reason == "steps"


def test_search_in_lockstep(panel):
    model = fr.Frontier("y", ["x1"], effect="quadrature", nodes=7)
    found = inference.search(panel, model, starts=6)
    assert len(found.fits) == 6 and sum(f.converged for f in found.fits) >= 5 and found.table.count() == 6
    assert found.fits[0].loglik == pytest.approx(fr.fit(panel, model).loglik, abs=1e-4)
    assert found.jobs < sum(f.steps for f in found.fits)
    with pytest.raises(ValueError):
        inference.search(panel, fr.Frontier("y", ["x1"], zvi0=["x1"]), starts=2)


def two_classes(spark, firms=70):
    a = fr.simulated_panel(spark, firms, 5, [1.0, 0.6], LOG_S2, seed=1)
    b = fr.simulated_panel(spark, firms, 5, [1.9, 0.1], LOG_S2, seed=50).withColumn("id", F.col("id") + 1000)
    return a.union(b).withColumn("w", F.when(F.col("id") > 1000, 0.5).otherwise(-0.5) + F.rand(3).cast("double") * 0 + (F.col("id") % 5) * 0.3).cache()


def test_em_never_falls_and_converges(spark):
    both = two_classes(spark)
    model = mixture.Mixture(fr.Frontier("y", ["x1"], effect="quadrature", nodes=7), 2, ["w"])
    start = np.concatenate([[0.0, 0.0], [1.2, 0.5, -2.0, -3.0, -3.0], [1.6, 0.3, -2.0, -3.0, -3.0]])
    trace = []
    em = mixture.fit(both, model, start=start, method="em_ghq", trace=trace, options={"em_tol": 1e-4})
    assert em.converged and em.reason == "likelihood" and len(trace) > 4 and (np.diff(trace) >= -1e-9).all()
    newton = mixture.fit(both, model, start=em.theta)
    assert newton.converged and newton.loglik == pytest.approx(em.loglik, abs=0.05)
    short = mixture.fit(both, model, start=start, em=True, most_steps=1)
    assert not short.converged and short.reason == "steps" and short.loglik < em.loglik
    # An M-step at the maximum doesn't move: its objective's gradient there is the likelihood's.
    rows = fr.prepared(both, model).cache()
    kept = mixture.expectation(rows, newton.theta, model).cache()
    classes = np.split(newton.theta[2:], 2)
    found = fr.evaluate_asks(kept, [*(Ask(t, CURVED, c) for c, t in enumerate(classes)), Ask(newton.theta[:2], CURVED, 2)], mixture.MStep(model))
    assert all(np.linalg.norm(f.gradient) < 0.05 for f in found)
    assert kept.filter("size(tau) = 2").count() == em.n_firms


def test_class_search(spark):
    both = two_classes(spark, 40)
    model = mixture.Mixture(fr.Frontier("y", ["x1"], effect="quadrature", nodes=7), 2)
    found = inference.search(both, model, starts=3, width=0.5)
    assert found.fits[0].converged and found.table.filter("fitted is not null").count() >= 2


def test_class_efficiencies_and_effects(spark, panel):
    one = fr.Frontier("y", ["x1"], zuit=["z"], draws=10)
    two = mixture.Mixture(one, 2)
    theta = np.array([1.2, 0.5, -2.0, 0.3, -3.0, -2.5])
    twice = np.concatenate([[0.7], theta, theta])
    a = colombi.efficiencies(panel, theta, one, draws=100).toPandas().sort_values(["id", "time"], ignore_index=True)
    b = colombi.class_efficiencies(panel, twice, two, draws=100).toPandas().sort_values(["id", "time"], ignore_index=True)
    assert np.allclose(a["transient"], b["transient"], atol=1e-12) and np.allclose(b["transient_1"], b["transient_2"]) and np.allclose(a["overall"], b["overall"])
    single = inference.marginal_effects(panel, theta, one).agg(F.avg("Zuit_z")).first()[0]
    both = inference.class_effects(panel, twice, two)
    assert both.columns == ["id", "time", "Zuit_z", "Class1_Zuit_z", "Class2_Zuit_z"]
    assert both.agg(F.avg("Zuit_z")).first()[0] == pytest.approx(single)
    rows = fr.prepared(panel, two)
    assert inference.mean_effects(rows, [twice], two)[0, 0] == pytest.approx(single)
    sigmas = {(r["class"], r.term): r.value for r in inference.sigma_table(panel, twice, two).collect()}
    assert sigmas[1, "sigma_v"] == pytest.approx(math.exp(-1.5)) and sigmas[1, "lambda"] == sigmas[2, "lambda"] and len(sigmas) == 8


def test_efficiencies_of_firms_together_equal_those_of_each():
    rng, uniform = np.random.default_rng(1), colombi.uniform_draws(4, 200)
    r, s2u, s2v = rng.normal(size=(5, 3)) * 0.4, rng.uniform(0.05, 0.2, (5, 3)), rng.uniform(0.02, 0.1, (5, 3))
    s2u0, s2v0 = rng.uniform(0.01, 0.2, 5), rng.uniform(0.01, 0.1, 5)
    whole = colombi._equal_firms(r, s2u0, s2v0, s2u, s2v, 1, uniform)
    for k in range(5):
        assert np.allclose(whole[k], colombi.firm_efficiencies(r[k], s2u0[k], s2v0[k], s2u[k], s2v[k], 1, uniform))


def test_redrawn_laws(spark):
    """Moments of the drawn responses: truncated, persistent and fixed models, rows that share id and time, and classes."""
    base = spark.range(3000).select((F.col("id") % 600).alias("id"), F.lit(1).alias("time"), F.lit(0.0).alias("y"), F.lit(1.0).alias("x1"), F.col("id").cast("double").alias("z"))
    model = fr.Frontier("y", ["x1"], effect="none", distribution="truncated", intercept=False)
    mu, s2u, s2v = 0.5, 0.09, 0.01
    drawn = inference.pseudo_sample(base.select("id", "time", F.col("z").alias("y"), "x1"), np.array([2.0, math.log(s2u), math.log(s2v), mu]), model, 3)
    ratio = mu / math.sqrt(s2u)
    alpha = math.exp(-0.5 * ratio**2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-ratio / math.sqrt(2)))
    mean_u, var_u = mu + math.sqrt(s2u) * alpha, s2u * (1 - ratio * alpha - alpha**2)
    row = drawn.agg(F.avg("y"), F.var_samp("y")).first()
    assert row[0] == pytest.approx(2 - mean_u, abs=0.03) and row[1] == pytest.approx(var_u + s2v, rel=0.1)
    gtre = fr.Frontier("y", ["x1"], persistent=True, intercept=False, draws=2)
    drawn = inference.pseudo_sample(base, np.array([0.0, math.log(0.04), math.log(0.01), math.log(0.02), math.log(0.3)]), gtre, 3)
    row = drawn.agg(F.avg("y"), F.count_distinct("y")).first()
    assert row[0] == pytest.approx(-math.sqrt(2 / math.pi) * (0.2 + math.sqrt(0.3)), abs=0.08) and row[1] == 3000
    again = inference.pseudo_sample(base.repartition(7), np.array([0.0, math.log(0.04), math.log(0.01), math.log(0.02), math.log(0.3)]), gtre, 3)
    assert drawn.agg(F.sum("y")).first()[0] == pytest.approx(again.agg(F.sum("y")).first()[0], abs=1e-6)
    fixed = fr.Frontier("y", ["z"], effect="fixed")
    effects = base.withColumn("z", F.randn(1)).withColumn("y", F.col("z") + F.col("id") * 0.01 + 0.1 * F.randn(2)).cache()
    theta = np.array([1.0, math.log(0.01), math.log(0.01)])
    drawn = inference.pseudo_sample(effects, theta, fixed, 3)
    assert drawn.agg(F.corr("id", "y")).first()[0] > 0.8
    classes = mixture.Mixture(fr.Frontier("y", ["x1"], draws=2, intercept=False), 2)
    drawn = inference.pseudo_sample(base, np.array([math.log(3.0), 0.0, -9.0, -9.0, -9.0, 5.0, -9.0, -9.0, -9.0]), classes, 3)
    assert drawn.filter("y > 2.5").select("id").distinct().count() == pytest.approx(150, abs=40)
    assert drawn.groupBy("id").agg((F.max("y") - F.min("y")).alias("d")).filter("d > 1").isEmpty()


def test_bootstrap_of_a_truncated_model_covers_the_truth(spark):
    base = spark.range(1500).select(F.col("id"), F.lit(1).alias("time"), F.col("id").cast("double").alias("y"), F.randn(1).alias("x1"), F.randn(2).alias("z"))
    model = fr.Frontier("y", ["x1"], effect="none", distribution="truncated", mu=["z"])
    truth = np.array([1.0, 0.5, math.log(0.09), math.log(0.01), 0.4, 0.5])
    drawn = inference.pseudo_sample(base, truth, model, 11).cache()
    fitted = fr.fit(drawn, model, start=truth)
    assert fitted.converged
    (row,) = inference.bootstrap_effects(drawn, fitted, model, reps=12, level=0.9).collect()
    true_effect = inference.marginal_effects(drawn, truth, model).agg(F.avg("Zuit_z")).first()[0]
    assert row.term == "Zuit_z" and row.replicates >= 8 and row.low - 0.02 < true_effect < row.high + 0.02
    # The same ends as refits one by one.
    effects = []
    for k in range(3):
        again = fr.fit(inference.pseudo_sample(drawn, fitted.theta, model, 1, k), model, start=fitted.theta)
        effects.append(inference.marginal_effects(drawn, again.theta, model).agg(F.avg("Zuit_z")).first()[0])
    (three,) = inference.bootstrap_effects(drawn, fitted, model, reps=3).collect()
    assert [three.low, three.high] == pytest.approx([min(effects), max(effects)], abs=1e-5)


def test_effects_of_mean_and_persistent_part(spark, panel):
    cut = fr.Frontier("y", ["x1"], effect="none", distribution="truncated", mu=["z"], zuit=["x1", "z"])
    theta = np.array([1.0, 0.5, -2.0, 0.1, 0.2, -3.0, 0.3, 0.7])
    part = cut.split(theta)
    found = inference.marginal_effects(panel, theta, cut).select("x1", "z", "Zuit_x1", "Zuit_z").limit(5).collect()
    assert inference.effect_names(cut) == ["Zuit_x1", "Zuit_z"]

    def mean_u(x, z):
        mu, s = part["mu"] @ [1, z], math.exp(0.5 * (part["zuit"] @ [1, x, z]))
        return mu + s * math.exp(-0.5 * (mu / s) ** 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-mu / s / math.sqrt(2)))

    for r in found:
        assert r.Zuit_x1 == pytest.approx((mean_u(r.x1 + 1e-5, r.z) - mean_u(r.x1 - 1e-5, r.z)) / 2e-5, rel=1e-5)
        assert r.Zuit_z == pytest.approx((mean_u(r.x1, r.z + 1e-5) - mean_u(r.x1, r.z - 1e-5)) / 2e-5, rel=1e-5)
    gtre = fr.Frontier("y", ["x1"], zuit=["x1"], zui0=["z"], persistent=True, draws=3)
    assert inference.effect_names(gtre) == ["Zuit_x1", "Zui0_z"]
    theta = np.array([1.0, 0.5, -2.0, 0.4, -3.0, -3.0, -2.0, 0.6])
    means = inference.marginal_effects(panel, theta, gtre).agg(F.avg("Zuit_x1"), F.avg("Zui0_z")).first()
    assert inference.mean_effects(fr.prepared(panel, gtre), [theta], gtre)[0] == pytest.approx(list(means))


def test_scores_by_row_and_design(panel):
    model = fr.Frontier("y", ["x1"], zuit=["x1"], zvi0=["z"], draws=8, shuffled=True)
    theta = np.array([1.0, 0.5, -2.0, 0.1, -3.0, -3.0, 0.2])
    found = fr.score_rows(panel, theta, model)
    assert found.columns == ["id", "time", *model.terms()] and found.count() == panel.count()
    sums = np.array(found.agg(*[F.sum(F.col(f"`{t}`")) for t in model.terms()]).first())
    rows = fr.prepared(panel, model).cache()
    (here,) = fr.evaluate(rows, [theta], model)
    assert sums == pytest.approx(here.gradient)
    assert fr.evaluate(rows.repartition(3, "rank").sortWithinPartitions("rank", "time"), [theta], model)[0].loglik == pytest.approx(here.loglik)
    design = fr.model_matrix(panel, model)
    assert design.columns == ["id", "time", "y", *model.terms()] and design.filter("Zuit_cons <> 1 or Zuit_x1 <> x1").isEmpty()


def test_shuffled_places():
    for n in (1, 2, 7, 64, 1000, 4097):
        assert sorted(fr.shuffled_places(np.arange(n), n, 5, 2)) == list(range(n))
    assert not np.array_equal(fr.shuffled_places(np.arange(50), 50, 1), fr.shuffled_places(np.arange(50), 50, 2))


def test_start_values_are_no_worse(spark):
    """Random effects and slopes of determinants only replace the plain start where they are likelier."""
    for seed in range(3):
        base = fr.simulated_panel(spark, 50, 4, [1.0, 0.5], LOG_S2, seed=seed).withColumn("z", F.randn(seed)).withColumn("y", F.col("y") + F.exp(0.5 * F.col("z")) * 0.3 * F.randn(seed + 9)).cache()
        model = fr.Frontier("y", ["x1"], zvit=["z"], zuit=["z"], effect="quadrature", nodes=7)
        rows = fr.prepared(base, model).cache()
        plain = fr._starts_from(rows.select("rank", "y", F.col("x")[1].alias("x0"), "zuit", "zvit", "zvi0"), np.array([1.0, 0.5]), model)[0]
        best, other = (f.loglik for f in fr.evaluate_asks(rows, [Ask(fr.start_values(rows, model)), Ask(plain)], model))
        assert best >= other - 1e-6


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    points = [(k, [float(v) for v in (np.array([[0, 0], [5, 5], [0, 6]])[k % 3] + 0.3 * rng.normal(size=2))]) for k in range(90)]
    table = spark.createDataFrame(points, "key long, features array<double>").cache()
    found = {r.key: r.cluster for r in kmeans.clusters(table, "key", 3).collect()}
    assert len({(k % 3, c) for k, c in found.items()}) == 3
    assert {r.key: r.cluster for r in kmeans.clusters(table.repartition(5), "key", 3).collect()} == found
    # Four clusters of at least 20: the smallest is filled up, and no giver falls under its least.
    healed = kmeans.clusters(table, "key", 4, least=20).groupBy("cluster").count().collect()
    assert len(healed) == 4 and min(r["count"] for r in healed) >= 20
    centres, steps = kmeans.lloyd(table, np.array([[0.0, 1.0], [4.0, 4.0], [1.0, 5.0]]))
    again, sizes = kmeans.moved(kmeans.assigned(table, centres), centres)
    assert steps < 10 and np.allclose(again, centres, atol=1e-6) and sizes.tolist() == [30, 30, 30]
    with pytest.raises(ValueError):
        kmeans.clusters(table, "key", 4, least=40)


def test_numbered_over_the_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id").alias("w")).repartition(6)
    rows = pn.numbered(df, ["v"], "place").collect()
    assert all(r.place == r.v for r in rows) and len(rows) == 1000
    assert pn.numbered(df.limit(0), ["v"], "place").count() == 0
    assert sorted((r.v, r.code) for r in pn.factorize(df.select(F.expr("v div 10").alias("v")), "v", "code").distinct().collect()) == [(k, k + 1) for k in range(100)]


def test_fit_from_formulas(panel):
    made, model = formula.frontier(panel.withColumn("g", F.when(F.col("id") % 2 == 0, "a").otherwise("b")), "y ~ x1 + C(g)", zuit="~ log(z + 1)", effect="none")
    assert model.terms() == ["_cons", "x1", "g[b]", "Zuit_cons", "Zuit_log(z + 1)", "Zvit_cons"]
    by_hand = panel.withColumn("b", (F.col("id") % 2).cast("double")).withColumn("lz", F.log(F.col("z") + 1))
    a, b = fr.fit(made, model), fr.fit(by_hand, fr.Frontier("y", ["x1", "b"], zuit=["lz"], effect="none"))
    assert a.converged and np.allclose(a.theta, b.theta, atol=1e-4)
    made, model = formula.frontier(panel, "y ~ x1 - 1", effect="none")
    assert model.terms() == ["x1", "Zuit_cons", "Zvit_cons"] and fr.fit(made, model).n_obs == panel.count()
    for bad in ("z", "~ z - 1"):
        with pytest.raises(ValueError):
            formula.frontier(panel, "y ~ x1", zuit=bad)


def test_checks(panel):
    for bad in (dict(bases=(2, 4)), dict(zui0=["z"]), dict(effect="none", zvi0=["z"]), dict(draws=0), dict(burn_in=-1), dict(intercept=False, x=[])):
        with pytest.raises(ValueError):
            fr.Frontier("y", bad.pop("x", ["x1"]), **bad)
    with pytest.raises(ValueError, match="no such column: q"):
        fr.fit(panel, fr.Frontier("y", ["q"]))
    with pytest.raises(ValueError, match="id"):
        fr.fit(panel.drop("id"), fr.Frontier("y", ["x1"]))


def test_boundary_is_named(spark):
    """Without firm effects the variance of v_i0 goes to zero: its line has no standard error."""
    base = fr.simulated_panel(spark, 60, 4, [1.0, 0.5], LOG_S2 | {"vi0": -60.0}, seed=8)
    found = fr.fit(base, fr.Frontier("y", ["x1"], effect="quadrature", nodes=7))
    rows = {r.term: r for r in found.table(spark).collect()}
    for t in found.boundary():
        assert rows[t].std_error is None and rows[t].p_value is None
    assert found.boundary() in ([], ["Zvi0_cons"]) and rows["x1"].std_error > 0
    assert "z" in found.table(spark, normal=True).columns


def test_likelihoods_of_firms_and_differences(panel):
    model = fr.Frontier("y", ["x1"], zuit=["z"], draws=15, shuffled=True)
    theta = np.array([1.0, 0.5, -2.0, 0.1, -3.0, -3.0])
    rows = fr.prepared(panel, model).cache()
    (here,) = fr.evaluate(rows, [theta], model, curved=True)
    found = fr.firm_logliks(panel, theta, model)
    assert found.count() == here_firms(rows) and found.agg(F.sum("loglik")).first()[0] == pytest.approx(here.loglik)
    for accuracy in fr.STENCILS:
        gradient, hessian = fr.numeric_derivatives(rows, theta, model, accuracy)
        assert gradient == pytest.approx(here.gradient, rel=1e-4, abs=1e-4) and np.allclose(hessian, here.hessian, rtol=1e-4, atol=1e-3)
    with pytest.raises(ValueError):
        fr.numeric_derivatives(rows, theta, model, 3)


def here_firms(rows):
    return rows.select("rank").distinct().count()


def test_replicated_fits(spark):
    base = spark.range(800).select("id", F.lit(1).alias("time"), F.col("id").cast("double").alias("y"), F.randn(1).alias("x1"))
    model = fr.Frontier("y", ["x1"], effect="none")
    truth = np.array([1.0, 0.5, 2 * math.log(0.4), 2 * math.log(0.2)])
    found = inference.replicated_fits(base, truth, model, 8).cache()
    assert found.count() == 32
    row = found.filter("term = 'x1' and converged").agg(F.avg("estimate"), F.stddev("estimate"), F.avg("std_error"), F.count("*")).first()
    assert row[0] == pytest.approx(0.5, abs=0.02) and row[3] >= 6 and 0.3 < row[1] / row[2] < 3
    assert found.select("replicate").distinct().count() == 8
