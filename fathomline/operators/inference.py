"""What follows a fit: likelihood-ratio tests, searches over start values, marginal effects and their bootstrap intervals.

Searches and bootstraps are many fits in lockstep: all that go on share one evaluation job a step, so the jobs are as many as the longest fit has
steps, however many fits there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.special import chi2_sf, mills, ndtr, ndtri
from fathomline.operators import density
from fathomline.operators import frontier as FR
from fathomline.operators import mixture as MX
from fathomline.operators.optimise import Ask, Options, lockstep, newton
from fathomline.operators.optimise import search as searched
from fathomline.operators.panel import check_time_invariant, complete_cases, quoted

ROOT_TWO_OVER_PI = math.sqrt(2 / math.pi)
#: Log-variances of a start value stay within this bound in every row.
LOG_VARIANCE_BOUND = 10.0
#: A start that can't be used is drawn again, a fifth nearer to the model's own each time, so often.
RETRIES, SHRINK = 10, 0.8


def likelihood_ratio(one: tuple[float, int], other: tuple[float, int]) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p-value) of two nested models' (log-likelihood, number of parameters), in any order."""
    if one[1] == other[1]:
        raise ValueError("the models have equally many parameters")
    small, large = sorted((one, other), key=lambda m: m[1])
    statistic, df = max(0.0, 2 * (large[0] - small[0])), large[1] - small[1]
    return statistic, df, chi2_sf(statistic, df)


def variance_extremes(rows: DataFrame, thetas: Sequence[np.ndarray], model: FR.Frontier) -> np.ndarray:
    """The largest size of any log-variance in any of the prepared rows, for each parameter vector; one job."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(thetas))
        for block in FR._firm_blocks(batches, model):
            for k, theta in enumerate(thetas):
                for b, g in model.split(theta).items():
                    if b not in ("x", "mu"):
                        most[k] = max(most[k], np.abs(block[b] @ g).max(initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(thetas))), pa.array(most)], names=["at", "value"])

    out = np.zeros(len(thetas))
    for r in rows.mapInArrow(kernel, "at long, value double").groupBy("at").agg(F.max("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def valid_starts(rows: DataFrame, model: FR.Frontier | MX.Mixture, own: np.ndarray, starts: int, width: float, seed: int, bound: float) -> tuple[list[np.ndarray], list[float]]:
    """(start values, their log-likelihoods): the model's own, and random ones within width / 2 of it.

    One whose log-likelihood isn't finite is drawn again nearer to the model's own, and so is one of a frontier whose log-variances leave the
    bound in some row; after the last try it has minus infinity. An attempt of all that are open is one job, or two.
    """
    tried, scores = [own] * starts, [-math.inf] * starts
    opened = list(range(starts))
    for attempt in range(RETRIES + 1):
        for k in opened:
            rng = np.random.default_rng([seed, k, attempt])
            tried[k] = own + (k > 0) * width * SHRINK**attempt * rng.uniform(-0.5, 0.5, len(own))
        wide = variance_extremes(rows, [tried[k] for k in opened], model) if isinstance(model, FR.Frontier) else np.zeros(len(opened))
        found = FR.evaluate_asks(rows, [Ask(tried[k]) for k in opened], model)
        for k, sums, reach in zip(opened, found, wide):
            scores[k] = sums.loglik if np.isfinite(sums.loglik) and reach <= bound else -math.inf
        opened = [k for k in opened if k and not np.isfinite(scores[k])]
        if not opened:
            break
    return tried, scores


@dataclass
class SearchResult:
    """Fits, best first, and a row for each start: its own log-likelihood, that of its fit, and whether that converged."""

    fits: list[FR.Fit]
    table: DataFrame
    #: Evaluation jobs of the fits.
    jobs: int

    def __iter__(self):
        return iter((self.fits, self.table))


def search(
    panel: DataFrame, model: FR.Frontier | MX.Mixture, starts: int = 50, fits: int | None = None, width: float = 1.0, seed: int = 1, bound: float = LOG_VARIANCE_BOUND, method: str | None = None,
    options: dict | Options | None = None,
) -> SearchResult:
    """Fits from many start values in lockstep; of frontiers and of latent classes.

    fits: how many of the likeliest valid starts are fitted, all by default. See valid_starts for the starts.
    """
    if starts < 1:
        raise ValueError("starts must be >= 1")
    options = Options.of(options, maxit=150)
    FR.check_columns(panel, model)
    rows = FR.prepared(panel, model).persist()
    try:
        n_obs, n_firms = FR.counted(rows, model)
        check_time_invariant(complete_cases(panel, model.columns()), model.firm_columns())
        own = MX.start_values(rows, model) if isinstance(model, MX.Mixture) else FR.start_values(rows, model)
        tried, scores = valid_starts(rows, model, own, starts, width, seed, bound)
        order = [k for k in np.argsort(scores, kind="stable")[::-1] if np.isfinite(scores[k])][: fits or starts]
        jobs = 0

        def evaluate(asks: list[Ask]):
            nonlocal jobs
            jobs += 1
            return FR.evaluate_asks(rows, asks, model)

        found = lockstep([searched(method, tried[k], options, jumps=model.jumps) for k in order], evaluate)
        out = {k: FR.audited(f, model, n_obs, n_firms) for k, f in zip(order, found)}
        lines = [(k, float(v), out[k].loglik if k in out else None, out[k].converged if k in out else None) for k, v in enumerate(scores)]
        table = panel.sparkSession.createDataFrame(lines, "start long, loglik double, fitted double, converged boolean")
        return SearchResult(sorted(out.values(), key=lambda f: (not np.isfinite(f.loglik), -f.loglik)), table, jobs)
    finally:
        rows.unpersist()


def effect_names(model: FR.Frontier) -> list[str]:
    """Columns of marginal effects: a Zuit_ for each determinant of the transient inefficiency's mean or variance, a Zui0_ of the persistent one's."""
    return [f"Zuit_{c}" for c in sorted({*model.zuit, *model.mu})] + [f"Zui0_{c}" for c in sorted(model.zui0)]


def marginal_effects(panel: DataFrame, theta: np.ndarray, model: FR.Frontier) -> DataFrame:
    """The columns of panel, and for each of effect_names the slope of E[u_it], or E[u_i0], in the determinant.

    A truncated normal's mean before the cut moves with mu, its variance with zuit; a determinant of both has one slope.
    """
    part = model.split(theta)

    def linear(block: str, columns: Sequence[str]):
        out = F.lit(float(part[block][0]))
        for g, c in zip(part[block][1:], columns):
            out = out + float(g) * F.col(quoted(c))
        return out

    slope = lambda block, columns, c: float(dict(zip(columns, part[block][1:])).get(c, 0.0))
    s2u = F.exp(linear("zuit", model.zuit))
    out = []
    for c in sorted({*model.zuit, *model.mu}):
        gamma = slope("zuit", model.zuit, c)
        out.append((density.wang_tn(slope("mu", model.mu, c), gamma, linear("mu", model.mu), s2u) if "mu" in part else density.wang_hn(gamma, s2u)).alias(f"Zuit_{c}"))
    for c in sorted(model.zui0):
        out.append(density.wang_hn(slope("zui0", model.zui0, c), F.exp(linear("zui0", model.zui0))).alias(f"Zui0_{c}"))
    return panel.select("*", *out)


def block_effects(block: FR.Block, theta: np.ndarray, model: FR.Frontier) -> np.ndarray:
    """(rows, effect_names) of a block of prepared rows."""
    part = model.split(theta)
    slope = lambda b, columns, c: dict(zip(columns, part[b][1:])).get(c, 0.0)
    sigma, out = np.exp(0.5 * (block["zuit"] @ part["zuit"])), []
    ratio = block["mu"] @ part["mu"] / sigma if "mu" in part else np.zeros(len(sigma))
    alpha = mills(ratio)
    by_mean, by_variance = 1 - ratio * alpha - alpha * alpha, sigma / 2 * ((1 + ratio * ratio) * alpha + ratio * alpha * alpha)
    for c in sorted({*model.zuit, *model.mu}):
        out.append((slope("mu", model.mu, c) if "mu" in part else 0.0) * by_mean + slope("zuit", model.zuit, c) * by_variance)
    for c in sorted(model.zui0):
        out.append(slope("zui0", model.zui0, c) * 0.5 * ROOT_TWO_OVER_PI * np.exp(0.5 * (block["zui0"] @ part["zui0"])))
    return np.column_stack(out) if out else np.zeros((len(sigma), 0))


def class_effects(panel: DataFrame, theta: np.ndarray, model: MX.Mixture) -> DataFrame:
    """id, time, and for each of effect_names the slope weighted by the row's posteriors, as <name>, and in each class, as Class<k>_<name>."""
    rows = FR.prepared(panel, model)
    kinds, names = dict(rows.dtypes), effect_names(model.frontier)
    columns = [*names, *(f"Class{c + 1}_{n}" for c in range(model.classes) for n in names)]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in FR._firm_blocks(batches, model):
            thetas, kept = model.parts(theta)[1], {}
            paths = [FR.Paths(block, t, model.frontier, kept) for t in thetas]
            posterior = paths[0].spread(model.joined(block, theta, [p.loglik for p in paths])[2])
            each = [block_effects(block, t, model.frontier) for t in thetas]
            mixed = sum(posterior[:, [c]] * e for c, e in enumerate(each))
            found = np.hstack([mixed, *each])
            yield pa.RecordBatch.from_arrays([block["id"].combine_chunks(), block["time"].combine_chunks(), *map(pa.array, np.ascontiguousarray(found.T))], names=["id", "time", *columns])

    return rows.mapInArrow(kernel, ", ".join([f"id {kinds['id']}", f"time {kinds['time']}", *(f"`{c}` double" for c in columns)]))


def mean_effects(rows: DataFrame, thetas: Sequence[np.ndarray], model: FR.Frontier | MX.Mixture) -> np.ndarray:
    """(parameter vectors, effect_names): means over prepared rows, of classes weighted by the rows' posteriors; one job."""
    classes = isinstance(model, MX.Mixture)
    names = effect_names(model.frontier if classes else model)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((len(thetas), len(names))), 0
        for block in FR._firm_blocks(batches, model):
            n, kept = n + len(block["y"]), {}
            for k, theta in enumerate(thetas):
                if classes:
                    parts = model.parts(theta)[1]
                    paths = [FR.Paths(block, t, model.frontier, kept) for t in parts]
                    posterior = paths[0].spread(model.joined(block, theta, [p.loglik for p in paths])[2])
                    sums[k] += sum((posterior[:, [c]] * block_effects(block, t, model.frontier)).sum(axis=0) for c, t in enumerate(parts))
                else:
                    sums[k] += block_effects(block, theta, model).sum(axis=0)
        flat = np.append(sums.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], names=["at", "value"])

    flat = np.zeros(len(thetas) * len(names) + 1)
    for r in rows.mapInArrow(kernel, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[r["at"]] = r["value"]
    return flat[:-1].reshape(len(thetas), len(names)) / max(flat[-1], 1)


@dataclass(frozen=True)
class Redrawn:
    """A model whose responses are drawn anew inside the task: an ask's tag is the replicate.

    Uniform numbers are hashes of the seed, the replicate, the firm's rank and the row's place within the firm, so they are the same wherever
    and however often a firm is worked on, and no pseudo-panel is written or shuffled. Without a firm effect rank is a hash of the row, so
    rows equal in all columns are drawn equally.
    """

    model: FR.Frontier | MX.Mixture
    theta: np.ndarray
    seed: int

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(object.__getattribute__(self, "model"), name)

    def uniform(self, rank: np.ndarray, place: np.ndarray | int, kind: int, tag: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = FR.mixed(rank.astype(np.int64).view(np.uint64), self.seed, tag, kind) + np.asarray(place, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((FR.mixed(key) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52

    def response(self, block: FR.Block, tag: int) -> np.ndarray:
        starts = block["starts"]
        sizes = np.diff(np.append(starts, len(block["y"])))
        ranks = block["rank"][starts]
        if not isinstance(self.model, MX.Mixture):
            return self._of(block, self.theta, self.model, tag, ranks, sizes)
        z = block["zsp"][starts] @ self.model.parts(self.theta)[0].T
        prior = np.exp(z - z.max(axis=1, keepdims=True))
        edges = np.cumsum(prior / prior.sum(axis=1, keepdims=True), axis=1)[:, :-1]
        chosen = np.repeat((self.uniform(ranks, 0, 4, tag)[:, None] > edges).sum(axis=1), sizes)
        each = [self._of(block, t, self.model.frontier, tag, ranks, sizes) for t in self.model.parts(self.theta)[1]]
        return np.choose(chosen, each)

    def _of(self, block: FR.Block, theta: np.ndarray, model: FR.Frontier, tag: int, ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        part, starts = model.split(theta), block["starts"]
        rank, place = np.repeat(ranks, sizes), np.arange(len(block["y"])) - np.repeat(starts, sizes)
        sigma = np.exp(0.5 * (block["zuit"] @ part["zuit"]))
        u = self.uniform(rank, place, 0, tag)
        if "mu" in part:  # the upper part of the law, as far as it lies above zero
            mu = block["mu"] @ part["mu"]
            u = mu - sigma * ndtri(np.clip(u * ndtr(mu / sigma), 1e-300, 1 - 1e-16))
        else:
            u = sigma * np.abs(ndtri(u))
        y = block["x"] @ part["x"] + np.exp(0.5 * (block["zvit"] @ part["zvit"])) * ndtri(self.uniform(rank, place, 1, tag)) - model.s * u
        if model.effect == "fixed":
            return y + np.repeat(FR.Paths(block, theta, model, {}).fixed[:, 0], sizes)
        if "zvi0" in part:
            y = y + np.repeat(np.exp(0.5 * (block["zvi0"][starts] @ part["zvi0"])) * ndtri(self.uniform(ranks, 0, 2, tag)), sizes)
        if model.persistent:
            y = y - model.s * np.repeat(np.exp(0.5 * (block["zui0"][starts] @ part["zui0"])) * np.abs(ndtri(self.uniform(ranks, 0, 3, tag))), sizes)
        return y

    def _block(self, block: FR.Block, kept: dict, tag: int) -> FR.Block:
        key = ("replicate", tag)
        if key not in kept:
            kept[key] = block | {"y": self.response(block, tag)}
        return kept[key]

    def value(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int) -> np.ndarray:
        return self.model.value(self._block(block, kept, tag), theta, kept)

    def scores(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int):
        return self.model.scores(self._block(block, kept, tag), theta, kept)

    def curvature(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int):
        return self.model.curvature(self._block(block, kept, tag), theta, kept)


def pseudo_sample(panel: DataFrame, theta: np.ndarray, model: FR.Frontier | MX.Mixture, seed: int, replicate: int = 0) -> DataFrame:
    """(id, time, y, and the model's columns) of the complete rows of panel, with the response drawn anew from the model.

    The same numbers as the bootstrap's replicate with that seed. Rows that share id and time are drawn apart.
    """
    rows, drawn = FR.prepared(panel, model), Redrawn(model, theta, seed)
    kinds = dict(rows.dtypes)
    frontier = model.frontier if isinstance(model, MX.Mixture) else model
    blocks, constants = model.blocks(), {b: size - len(model.blocks()[b]) for b, size in model.sizes().items()}
    columns = {c: (b, k + constants[b]) for b, cols in blocks.items() for k, c in enumerate(cols)}
    columns.pop(frontier.y, None)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in FR._firm_blocks(batches, model):
            values = [drawn.response(block, replicate), *(np.ascontiguousarray(block[b][:, k]) for b, k in columns.values())]
            yield pa.RecordBatch.from_arrays([block["id"].combine_chunks(), block["time"].combine_chunks(), *map(pa.array, values)], names=["id", "time", frontier.y, *columns])

    return rows.mapInArrow(kernel, ", ".join([f"id {kinds['id']}", f"time {kinds['time']}", *(f"`{c}` double" for c in (frontier.y, *columns))]))


def bootstrap_effects(panel: DataFrame, fitted: FR.Fit, model: FR.Frontier | MX.Mixture, reps: int = 50, level: float = 0.95, seed: int = 1) -> DataFrame:
    """(term, effect, low, high, replicates): mean marginal effects with parametric bootstrap intervals of refits to pseudo-samples.

    All refits run in lockstep. One that doesn't converge is replaced by a further replicate, up to 2 * reps in all; with none that
    converges the ends are null. They are the sorted effects at index floor(p n).
    """
    if not 0 < level < 1 or reps < 1:
        raise ValueError("level must be between 0 and 1, and reps >= 1")
    spark: SparkSession = panel.sparkSession
    names = effect_names(model.frontier if isinstance(model, MX.Mixture) else model)
    if not names:
        raise ValueError("the model has no determinants of inefficiency")
    rows = FR.prepared(panel, model).persist()
    try:
        drawn, options, found, next_tag = Redrawn(model, fitted.theta, seed), Options(maxit=60), [], 0
        while len(found) < reps and next_tag < 2 * reps:
            tags = range(next_tag, min(2 * reps, next_tag + reps - len(found)))
            next_tag = tags.stop
            refits = lockstep([newton(fitted.theta, options, t) for t in tags], lambda asks: FR.evaluate_asks(rows, asks, drawn))
            found += [f.theta for f in refits if f.converged]
        effects = mean_effects(rows, [fitted.theta, *found], model)
    finally:
        rows.unpersist()
    ends = np.sort(effects[1:], axis=0)
    at = lambda p: [float(v) for v in ends[min(len(ends) - 1, int(p * len(ends)))]] if len(ends) else [None] * len(names)
    lines = zip(names, map(float, effects[0]), at((1 - level) / 2), at((1 + level) / 2))
    return spark.createDataFrame([(*line, len(found)) for line in lines], "term string, effect double, low double, high double, replicates int")


def replicated_fits(panel: DataFrame, theta: np.ndarray, model: FR.Frontier | MX.Mixture, reps: int, seed: int = 1, start: np.ndarray | None = None, options: dict | Options | None = None) -> DataFrame:
    """(replicate, term, truth, estimate, std_error, converged): fits to reps responses drawn from the model at theta, in lockstep.

    std_error is null where the fit didn't converge or the term is on the boundary. The rows are what measures of bias,
    spread and coverage are aggregated from.
    """
    if reps < 1:
        raise ValueError("reps must be >= 1")
    truth, options = FR.checked_start(theta, model), Options.of(options)
    rows = FR.prepared(panel, model).persist()
    try:
        n_obs, n_firms = FR.counted(rows, model)
        drawn, at = Redrawn(model, truth, seed), truth if start is None else FR.checked_start(start, model)
        found = lockstep([newton(at, options, k) for k in range(reps)], lambda asks: FR.evaluate_asks(rows, asks, drawn))
    finally:
        rows.unpersist()
    lines = []
    for k, f in enumerate(found):
        fitted = FR.audited(f, model, n_obs, n_firms)
        se, edge = np.sqrt(np.maximum(np.diag(fitted.vcov()), 0)), set(fitted.boundary())
        lines += [(k, t, float(truth[j]), float(f.theta[j]), float(se[j]) if f.converged and t not in edge and se[j] > 0 else None, f.converged) for j, t in enumerate(model.terms())]
    return panel.sparkSession.createDataFrame(lines, "replicate int, term string, truth double, estimate double, std_error double, converged boolean")


def sigma_table(panel: DataFrame, theta: np.ndarray, model: FR.Frontier | MX.Mixture) -> DataFrame:
    """(class, term, value): mean standard deviations of the parts, and the means of their ratios, over the rows; class is null without classes.

    lambda is sigma_u / sigma_v, lambda_0 sigma_u0 / sigma_v0, and capital_lambda sqrt(s2u + s2u0) / sqrt(s2v + s2v0), of the parts the model has.
    """
    rows = FR.prepared(panel, model)
    frontier = model.frontier if isinstance(model, MX.Mixture) else model
    thetas = model.parts(theta)[1] if isinstance(model, MX.Mixture) else [theta]
    linear = lambda b, g: sum((float(v) * F.col(b)[k] for k, v in enumerate(g)), F.lit(0.0))
    columns, named = [], []
    for c, t in enumerate(thetas):
        part = frontier.split(t)
        s2 = {b: F.exp(linear(b, g)) for b, g in part.items() if b not in ("x", "mu")}
        u0, v0 = s2.get("zui0"), s2.get("zvi0")
        values = {"sigma_u": F.sqrt(s2["zuit"]), "sigma_v": F.sqrt(s2["zvit"]), "lambda": F.sqrt(s2["zuit"] / s2["zvit"])}
        values |= {"sigma_v0": F.sqrt(v0)} if v0 is not None else {}
        values |= {"sigma_u0": F.sqrt(u0), "lambda_0": F.sqrt(u0 / v0), "capital_lambda": F.sqrt((s2["zuit"] + u0) / (s2["zvit"] + v0))} if u0 is not None else {}
        for name, value in values.items():
            named.append((c + 1 if len(thetas) > 1 else None, name))
            columns.append(F.avg(value).alias(f"c{len(columns)}"))
    pairs = F.array(*[F.struct(F.lit(c).cast("int").alias("class"), F.lit(n).alias("term"), F.col(f"c{k}").alias("value")) for k, (c, n) in enumerate(named)])
    return rows.agg(*columns).select(F.explode(pairs).alias("r")).select("r.*")
