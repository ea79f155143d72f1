"""Latent classes of frontiers: firms (or rows, without a firm effect) belong to one of several, with a logit of their own traits.

The likelihood of a firm is the prior-weighted mean of its likelihoods in the classes. The Hessian is that of the classes at the
present posteriors plus the posterior variance of the complete-data scores (Louis). Taken without the second part it is the
curve to which a Newton search goes back where the whole isn't negative definite.

EM searches keep each firm's posteriors, and the quadrature nodes that were set at the same parameters, as columns of the firm's first row.
Until the next such step they stand still, so an M-step is a fixed, smooth problem for each class and one for the priors; these
are solved by Newton searches in lockstep, on one job a step for all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators import frontier as FR
from fathomline.operators import kmeans
from fathomline.operators.optimise import Found, Options, lockstep, newton
from fathomline.operators.panel import check_time_invariant, complete_cases
from fathomline.operators.regression import ols

#: A cluster has at least this share of the firms over the number of classes.
LEAST_SHARE = 0.2


@dataclass(frozen=True)
class Mixture:
    """Classes of one frontier model with parameters of their own; z are the traits that the priors depend on, the last class the base."""

    frontier: FR.Frontier
    classes: int = 2
    z: Sequence[str] = ()

    def __post_init__(self):
        if self.classes < 2:
            raise ValueError("classes must be >= 2")
        if self.frontier.persistent:
            raise ValueError("classes have no persistent inefficiency")
        if self.frontier.effect == "fixed":
            raise ValueError("classes have no fixed effects")

    @property
    def y(self) -> str:
        return self.frontier.y

    @property
    def effect(self) -> str:
        return self.frontier.effect

    def blocks(self) -> dict[str, Sequence[str]]:
        return self.frontier.blocks() | {"zsp": self.z}

    def sizes(self) -> dict[str, int]:
        return self.frontier.sizes() | {"zsp": len(self.z) + 1}

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.frontier.columns(), *self.z]))

    def firm_columns(self) -> list[str]:
        return [*self.frontier.firm_columns(), *(self.z if self.effect != "none" else ())]

    def width(self) -> int:
        return self.frontier.width()

    def terms(self) -> list[str]:
        priors = [f"Class{c}_Zsp_{t}" for c in range(1, self.classes) for t in ("cons", *self.z)]
        return priors + [f"Class{c}_{t}" for c in range(1, self.classes + 1) for t in self.frontier.terms()]

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(classes, traits) of the priors, with zeros for the base, and each class's parameters."""
        k = (self.classes - 1) * (len(self.z) + 1)
        return np.vstack([theta[:k].reshape(self.classes - 1, -1), np.zeros(len(self.z) + 1)]), np.split(theta[k:], self.classes)

    def jumps(self, theta: np.ndarray) -> list[np.ndarray]:
        """theta with the jumps of one class, or of all that have any."""
        first = (self.classes - 1) * (len(self.z) + 1)
        parts = np.split(theta[first:], self.classes)
        each = [self.frontier.jumps(p) for p in parts]
        join = lambda chosen: np.concatenate([theta[:first], *chosen])
        out = [join([j if k == c else p for k, p in enumerate(parts)]) for c, found in enumerate(each) for j in found]
        return out + ([join([found[-1] if found else p for p, found in zip(parts, each)])] if sum(map(bool, each)) > 1 else [])

    def joined(self, block: FR.Block, theta: np.ndarray, classes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Log-likelihood, priors and posteriors of each firm from its log-likelihoods in the classes."""
        z = block["zsp"][block["starts"]] @ self.parts(theta)[0].T
        prior = np.exp(z - z.max(axis=1, keepdims=True))
        prior /= prior.sum(axis=1, keepdims=True)
        terms = np.log(np.maximum(prior, 1e-300)) + np.column_stack(classes)
        top = terms.max(axis=1, keepdims=True)
        weights = np.exp(terms - top)
        total = weights.sum(axis=1, keepdims=True)
        return (top + np.log(total))[:, 0], prior, weights / total

    @property
    def shuffled(self) -> bool:
        return self.frontier.shuffled

    def constant(self) -> bool:
        return self.frontier.constant()

    def value(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int = 0) -> np.ndarray:
        return self.joined(block, theta, [FR.Paths(block, t, self.frontier, kept).loglik for t in self.parts(theta)[1]])[0]

    def scores(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int = 0) -> tuple[np.ndarray, np.ndarray]:
        found = [FR.firm_scores(block, t, self.frontier, kept) for t in self.parts(theta)[1]]
        loglik, prior, posterior = self.joined(block, theta, [f[0] for f in found])
        z = block["zsp"][block["starts"]]
        free = (posterior - prior)[:, : self.classes - 1]
        seg = (free[:, :, None] * z[:, None, :]).reshape(len(z), -1)
        return loglik, np.hstack([seg, *(posterior[:, [c]] * f[1] for c, f in enumerate(found))])

    def curvature(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        thetas, z = self.parts(theta)[1], block["zsp"][block["starts"]]
        loglik, prior, posterior = self.joined(block, theta, [FR.Paths(block, t, self.frontier, kept).loglik for t in thetas])
        found = [FR.firm_curvature(block, t, self.frontier, kept, posterior[:, c]) for c, t in enumerate(thetas)]
        n, k, p = self.classes, z.shape[1], len(thetas[0])
        first = (n - 1) * k
        complete = np.zeros((first + n * p,) * 2)
        for a in range(n - 1):
            for b in range(n - 1):
                curve = prior[:, a] * ((a == b) - prior[:, b])
                complete[a * k : (a + 1) * k, b * k : (b + 1) * k] = -(z * curve[:, None]).T @ z
        mean, spread = np.zeros((len(z), len(complete))), np.zeros_like(complete)
        for c, (_, score, hessian) in enumerate(found):
            at = slice(first + c * p, first + (c + 1) * p)
            complete[at, at] = hessian
            whole = np.zeros((len(z), len(complete)))
            whole[:, :first] = ((np.arange(n - 1) == c)[None, :, None] - prior[:, : n - 1, None]).repeat(k, axis=2).reshape(len(z), -1) * np.tile(z, n - 1)
            whole[:, at] = score
            mean += posterior[:, [c]] * whole
            spread += (whole * posterior[:, [c]]).T @ whole
        return loglik, mean, complete + spread - mean.T @ mean, complete


@dataclass(frozen=True)
class MStep:
    """The objectives of an M-step: tag c is class c's likelihood weighted by the posteriors, tag classes that of the priors."""

    mixture: Mixture
    #: Columns that expectation adds.
    by_firm: tuple[str, ...] = ("tau", "nodes", "log_weights")

    @property
    def effect(self) -> str:
        return self.mixture.effect

    def sizes(self) -> dict[str, int]:
        return self.mixture.sizes()

    def width(self) -> int:
        return self.mixture.width()

    def _class(self, block: FR.Block, kept: dict, tag: int) -> tuple[np.ndarray, dict]:
        """The class's weight of each firm, and what its likelihood keeps: the draws of all classes, or its own frozen nodes."""
        if self.effect == "quadrature":
            nodes = [block[c].reshape(len(block["starts"]), self.mixture.classes, -1)[:, tag] for c in ("nodes", "log_weights")]
            return block["tau"][:, tag], {"nodes": tuple(nodes)}
        return block["tau"][:, tag], kept

    def _priors(self, block: FR.Block, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = block["zsp"][block["starts"]]
        score = z @ np.vstack([theta.reshape(-1, z.shape[1]), np.zeros(z.shape[1])]).T
        score -= score.max(axis=1, keepdims=True)
        log_prior = score - np.log(np.exp(score).sum(axis=1, keepdims=True))
        return z, np.exp(log_prior), (block["tau"] * log_prior).sum(axis=1)

    def value(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int) -> np.ndarray:
        if tag == self.mixture.classes:
            return self._priors(block, theta)[2]
        weight, held = self._class(block, kept, tag)
        return weight * FR.Paths(block, theta, self.mixture.frontier, held).loglik

    def curvature(self, block: FR.Block, theta: np.ndarray, kept: dict, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if tag == self.mixture.classes:
            z, prior, value = self._priors(block, theta)
            n, k = self.mixture.classes - 1, z.shape[1]
            whole = block["tau"].sum(axis=1)
            score = ((block["tau"] - whole[:, None] * prior)[:, :n, None] * z[:, None, :]).reshape(len(z), -1)
            hessian = np.zeros((n * k, n * k))
            for a in range(n):
                for b in range(n):
                    curve = whole * prior[:, a] * ((a == b) - prior[:, b])
                    hessian[a * k : (a + 1) * k, b * k : (b + 1) * k] = -(z * curve[:, None]).T @ z
            return value, score, hessian, hessian - 1e-8 * np.eye(n * k)
        weight, held = self._class(block, kept, tag)
        loglik, score, hessian = FR.firm_curvature(block, theta, self.mixture.frontier, held, weight)
        return weight * loglik, score * weight[:, None], hessian, hessian


def expectation(rows: DataFrame, theta: np.ndarray, model: Mixture) -> DataFrame:
    """rows with tau (posteriors), nodes and log_weights (of all classes in turn) and loglik, on each firm's first row, at theta."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in FR._firm_blocks(batches, model):
            kept: dict = {}
            paths = [FR.Paths(block, t, model.frontier, kept) for t in model.parts(theta)[1]]
            loglik, _, tau = model.joined(block, theta, [p.loglik for p in paths])
            frozen = [np.zeros((len(loglik), 0))] * 2
            if model.effect == "quadrature":
                frozen = [np.hstack([p.nodes[k] for p in paths]) for k in (0, 1)]
            sizes = np.zeros(len(block["y"]), np.int32)
            columns = [pa.array(block["rank"])]
            for values in (tau, *frozen, loglik[:, None]):
                sizes[block["starts"]] = values.shape[1]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.ascontiguousarray(values).ravel())))
            columns += [block["id"].combine_chunks(), block["time"].combine_chunks(), pa.array(block["y"])]
            for b, size in model.sizes().items():
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, block[b].size + 1, size, dtype=np.int32) if size else np.zeros(len(block["y"]) + 1, np.int32)), pa.array(np.ascontiguousarray(block[b]).ravel())))
            if "firms" in block:
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(block["y"]) + 1, dtype=np.int32)), pa.array(block["firms"])))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(rows.dtypes)
    added = ["tau", "nodes", "log_weights", "loglik"]
    names = ["rank", *added, "id", "time", "y", *model.sizes(), *(["firms"] if "firms" in kinds else [])]
    return rows.mapInArrow(kernel, ", ".join(f"{c} {'array<double>' if c in added else kinds[c]}" for c in names))


def expectation_maximisation(rows: DataFrame, theta: np.ndarray, model: Mixture, options: Options, trace: list[float] | None = None) -> Found:
    """EM steps from theta, until one adds less than em_tol to the log-likelihood, or em_max_iter of them; trace gets it at each.

    An M-step goes to the top of each class's objective and of the priors', which are maximised in lockstep. One that would lower
    the log-likelihood, as the nodes' move may by what quadrature rounds off, isn't taken, and ends the search.
    """
    objective, first = MStep(model), (model.classes - 1) * (len(model.z) + 1)
    kept, before, last, reason, steps = None, -np.inf, theta, "steps", 0
    try:
        for steps in range(options.em_max_iter + 1):
            now = expectation(rows, theta, model).persist()
            loglik = now.agg(F.sum(F.get("loglik", F.lit(0)))).first()[0]
            if kept is not None:
                kept.unpersist()
            kept = now
            if loglik < before:
                theta, reason = last, "likelihood"
                break
            if trace is not None:
                trace.append(loglik)
            if loglik - before < options.em_tol:
                reason = "likelihood"
                break
            if steps == options.em_max_iter:
                break
            before, last = loglik, theta
            alpha, classes = theta[:first], np.split(theta[first:], model.classes)
            tolerance = min(1e-3, options.grad_err_tol)
            searches = [newton(t, options, c, options.em_class_max_iter, tolerance, model.frontier.jumps) for c, t in enumerate(classes)]
            searches.append(newton(alpha, options, model.classes, options.em_seg_max_iter, 1e-8))
            found = lockstep(searches, lambda asks: FR.evaluate_asks(kept, asks, objective))  # noqa: B023
            theta = np.concatenate([found[-1].theta, *(f.theta for f in found[:-1])])
    finally:
        if kept is not None:
            kept.unpersist()
    (here,) = FR.evaluate(rows, [theta], model, curved=True)
    return Found(theta, here, reason == "likelihood", steps, reason)


def hard_priors(rows: DataFrame, clusters: DataFrame, model: Mixture) -> np.ndarray:
    """Parameters of the priors that fit clusters(rank, cluster) best: a multinomial logit by Newton steps on aggregates.

    A cluster that its traits tell apart wholly would send them to infinity; ten steps end before that.
    """
    first = F.col("place") == 1
    hot = F.array(*[(F.col("cluster") == c).cast("double") for c in range(model.classes)])
    ordered = rows.join(clusters, "rank")
    numbered = ordered.withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy("time")))
    none = F.array().cast("array<double>")
    parts = rows.rdd.getNumPartitions()
    held = numbered.select(*rows.columns, F.when(first, hot).otherwise(none).alias("tau"), none.alias("nodes"), none.alias("log_weights")).repartition(parts, "rank").sortWithinPartitions("rank", "time").persist()
    try:
        priors = MStep(model, ("tau",))
        start = np.zeros((model.classes - 1) * (len(model.z) + 1))
        (found,) = lockstep([newton(start, Options(), model.classes, 10, 1e-6)], lambda asks: FR.evaluate_asks(held, asks, priors))
        return found.theta
    finally:
        held.unpersist()


def _by_share(theta: np.ndarray, model: Mixture, shares: Sequence[float]) -> np.ndarray:
    alpha = np.zeros((model.classes - 1, len(model.z) + 1))
    alpha[:, 0] = np.log(np.array(shares[:-1]) / shares[-1])
    return np.concatenate([alpha.ravel(), theta])


def firm_traits(rows: DataFrame, model: Mixture) -> DataFrame:
    """(rank, features): mean, variance and skewness of each firm's least-squares residuals, over their spread among the firms.

    The variance has one less than the periods below it; the skewness is the mean cube over that variance's root cubed, of three periods at least.
    """
    ahead = int(model.constant())
    xs = [f"x{k}" for k in range(len(model.frontier.x))]
    flat = rows.select("rank", "y", *[F.col("x")[k + ahead].alias(x) for k, x in enumerate(xs)])
    b = ols(flat, "y", xs)
    r = F.col("y") - float(b[0]) - sum((float(v) * F.col(x) for v, x in zip(b[1:], xs)), F.lit(0.0))
    sums = flat.groupBy("rank").agg(F.count("*").alias("n"), F.avg(r).alias("a"), F.var_samp(r).alias("v"), F.avg(r * r).alias("m2"), F.avg(r * r * r).alias("m3"))
    cube = F.col("m3") - 3 * F.col("a") * F.col("m2") + 2 * F.col("a") * F.col("a") * F.col("a")
    spread = F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0))
    skew = F.when((F.col("n") >= 3) & (spread > 0), cube / F.pow(spread, 1.5)).otherwise(0.0)
    traits = sums.select("rank", "a", spread.alias("b"), skew.alias("c"))
    ends = traits.agg(*[f(c).alias(f"{c}{k}") for c in "abc" for k, f in enumerate((F.avg, F.stddev))]).first()
    scaled = [(F.col(c) - float(ends[f"{c}0"])) / max(float(ends[f"{c}1"] or 0), 1e-12) for c in "abc"]
    return traits.select("rank", F.array(*scaled).alias("features"))


def start_values(rows: DataFrame, model: Mixture) -> np.ndarray:
    """Of panels: k-means on the firms' residuals (firm_traits), then start values in each cluster, priors by a logit of the clusters.

    A cluster with fewer firms than that needs takes all firms' values, its slopes moved by 0.05 for each class from the middle. Of rows
    without a firm effect: all rows' values with slopes stretched by a tenth for each class from the middle, about the mean of x.
    """
    whole, n = FR.start_values(rows, model.frontier), model.classes
    ahead = int(model.constant())
    middle, slopes = np.arange(n) - (n - 1) / 2, len(model.frontier.x) + ahead
    if model.effect == "none":
        mean = np.array([1.0] * ahead + list(rows.agg(*[F.avg(F.col("x")[k]) for k in range(ahead, slopes)]).first() if slopes > ahead else []))
        moved = np.outer(1 + 0.1 * middle, whole[:slopes])
        if ahead:
            moved[:, 0] = whole[0] - (moved[:, 1:] - whole[1:slopes]) @ mean[1:]
        return _by_share(np.concatenate([np.concatenate([m, whole[slopes:]]) for m in moved]), model, [1 / n] * n)
    traits = firm_traits(rows, model).persist()
    groups = None
    try:
        firms = traits.count()
        if firms < n:
            raise ValueError("there are fewer firms than classes")
        groups = kmeans.clusters(traits, "rank", n, least=max(1, int(LEAST_SHARE * firms / n))).persist()
        sizes = {r["cluster"]: r["count"] for r in groups.groupBy("cluster").count().collect()}
        out = []
        for c in range(n):
            if sizes.get(c, 0) > 2 * len(whole):
                out.append(FR.start_values(rows.join(groups.filter(F.col("cluster") == c), "rank"), model.frontier))
            else:
                out.append(np.concatenate([whole[:ahead], whole[ahead:slopes] + 0.05 * middle[c], whole[slopes:]]))
        shares = [max(sizes.get(c, 0), 0.5) / firms for c in range(n)]
        if not model.z:
            return _by_share(np.concatenate(out), model, shares)
        return np.concatenate([hard_priors(rows, groups, model), *out])
    finally:
        traits.unpersist()
        if groups is not None:
            groups.unpersist()


def fit(
    panel: DataFrame, model: Mixture, start: np.ndarray | None = None, most_steps: int | None = None, tolerance: float | None = None, em: bool = False, method: str | None = None,
    options: dict | Options | None = None, trace: list[float] | None = None,
) -> FR.Fit:
    """Maximum of the mixture's likelihood; see frontier.fit. em, or the method em_ghq: by EM steps, see expectation_maximisation.

    An EM fit is converged if a step added less than em_tol; most_steps then stands for em_max_iter, and trace gets the log-likelihoods.
    """
    em = em or method == "em_ghq"
    given = {k: v for k, v in (("em_max_iter" if em else "maxit", most_steps), ("grad_err_tol", tolerance)) if v is not None}
    options = Options.of(options, **given)
    model = replace(model, frontier=FR.with_nodes(model.frontier, options)) if em else model
    FR.check_columns(panel, model)
    rows = FR.prepared(panel, model).persist()
    try:
        n_obs, n_firms = FR.counted(rows, model)
        check_time_invariant(complete_cases(panel, model.columns()), model.firm_columns())
        theta = start_values(rows, model) if start is None else FR.checked_start(start, model)
        if em:
            return FR.audited(expectation_maximisation(rows, theta, model, options, trace), model, n_obs, n_firms)
        return FR.maximise(rows, model, theta, n_obs, n_firms, options, method)
    finally:
        rows.unpersist()


def posteriors(panel: DataFrame, theta: np.ndarray, model: Mixture) -> DataFrame:
    """id, time, class (from 1), prior and posterior of each row and class; in panels those of the firm."""
    rows = FR.prepared(panel, model)
    kinds = dict(rows.dtypes)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in FR._firm_blocks(batches, model):
            paths = [FR.Paths(block, t, model.frontier, {}) for t in model.parts(theta)[1]]
            _, prior, posterior = model.joined(block, theta, [p.loglik for p in paths])
            for c in range(model.classes):
                each = [pa.array(paths[0].spread(x[:, c])) for x in (prior, posterior)]
                yield pa.RecordBatch.from_arrays([block["id"].combine_chunks(), block["time"].combine_chunks(), pa.array(np.full(len(block["y"]), c + 1, np.int64)), *each], names=["id", "time", "class", "prior", "posterior"])

    return rows.mapInArrow(kernel, f"id {kinds['id']}, time {kinds['time']}, class long, prior double, posterior double")


def efficiencies(panel: DataFrame, theta: np.ndarray, model: Mixture) -> DataFrame:
    """id, time, class with the largest posterior, inefficiency and efficiency weighted by the posteriors."""
    rows = FR.prepared(panel, model)
    kinds = dict(rows.dtypes)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in FR._firm_blocks(batches, model):
            paths = [FR.Paths(block, t, model.frontier, {}) for t in model.parts(theta)[1]]
            posterior = paths[0].spread(model.joined(block, theta, [p.loglik for p in paths])[2])
            u, eff = np.zeros(len(posterior)), np.zeros(len(posterior))
            for c, p in enumerate(paths):
                for total, rows_of_class in zip((u, eff), p.inefficiency()):
                    total += posterior[:, c] * rows_of_class
            columns = [block["id"].combine_chunks(), block["time"].combine_chunks(), pa.array(posterior.argmax(axis=1) + 1), pa.array(u), pa.array(eff)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "time", "class", "inefficiency", "efficiency"])

    return rows.mapInArrow(kernel, f"id {kinds['id']}, time {kinds['time']}, class long, inefficiency double, efficiency double")
