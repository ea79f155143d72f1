"""Persistent and transient efficiencies of four-component panels, from probabilities of normal orthants.

Given a firm's composed errors r, its inefficiencies u = (u_i0, u_i1, ..., u_iT) are normal with mean Rr and covariance L, cut to
the positive orthant; so E[exp(-t'u)] is exp(t'Lt / 2 - t'Rr) times the ratio of two orthant probabilities. These are simulated
by sequential conditioning (GHK) with a Halton sequence for each dimension. A task takes the firms of a block with equally many
periods together: their covariances are factored, and their orthants simulated, as one array. With latent classes this is done at each
class's parameters, and the classes' efficiencies are weighted by the firm's posteriors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.functions.special import ndtr, ndtri
from fathomline.operators import frontier as FR
from fathomline.operators import mixture as MX

#: Draws of an orthant probability, and numbers that a sequence drops first.
DRAWS, BURN_IN = 2000, 1000
#: Least variance and least eigenvalue.
LEAST_VARIANCE, LEAST_EIGENVALUE = 1e-10, 1e-8
#: Numbers of an array that a task holds for the draws of one coordinate of its firms' orthants.
BLOCK_CELLS = 4_000_000


def primes(n: int) -> list[int]:
    return list(islice((k for k in count(2) if all(k % d for d in range(2, math.isqrt(k) + 1))), n))


def uniform_draws(dimensions: int, draws: int, seed: int = 1) -> np.ndarray:
    """(dimensions, draws): scrambled Halton sequences in prime bases."""
    at = np.arange(draws) + BURN_IN + 1
    return np.stack([FR.halton(at, b, np.random.default_rng([seed, b]).permutation(b)) for b in primes(dimensions)])


def log_orthants(means: np.ndarray, factors: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Log probability that a normal vector is positive in all coordinates, for many: means (..., n), lower Cholesky factors (..., n, n)."""
    n = means.shape[-1]
    z = np.zeros((n, *means.shape[:-1], uniform.shape[1]))
    log_p = np.zeros((*means.shape[:-1], uniform.shape[1]))
    for j in range(n):
        above = (means[..., j, None] + np.einsum("...k,k...r->...r", factors[..., j, :j], z[:j])) / factors[..., j, j, None]
        p = np.maximum(ndtr(above), 1e-300)
        log_p += np.log(p)
        if j + 1 < n:
            z[j] = -ndtri(np.clip(uniform[j] * p, 1e-300, 1 - 1e-16))
    top = log_p.max(axis=-1, keepdims=True)
    return top[..., 0] + np.log(np.exp(log_p - top).mean(axis=-1))


def log_orthant(mean: np.ndarray, factor: np.ndarray, uniform: np.ndarray) -> float:
    """The same for one."""
    return float(log_orthants(mean[None], factor[None], uniform)[0])


def _factors(covariances: np.ndarray) -> np.ndarray:
    """Lower Cholesky factors; of a nearly singular matrix after its eigenvalues are lifted, NaN if that fails too."""
    try:
        return np.linalg.cholesky(covariances)
    except np.linalg.LinAlgError:
        pass
    out = np.full(covariances.shape, np.nan)
    for k, c in enumerate(covariances):
        for lifted in (False, True):
            try:
                if lifted:
                    values, vectors = np.linalg.eigh(c)
                    c = vectors @ np.diag(np.maximum(values, LEAST_EIGENVALUE)) @ vectors.T
                out[k] = np.linalg.cholesky(c)
                break
            except np.linalg.LinAlgError:
                pass
    return out


def _equal_firms(r: np.ndarray, s2u0: np.ndarray, s2v0: np.ndarray, s2u: np.ndarray, s2v: np.ndarray, s: int, uniform: np.ndarray) -> np.ndarray:
    """(firms, 1 + periods) efficiencies of firms with equally many periods: r, s2u and s2v are (firms, periods)."""
    f, n = r.shape
    spread = np.maximum(np.column_stack([s2u0, s2u]), LEAST_VARIANCE)
    a = -s * np.hstack([np.ones((n, 1)), np.eye(n)])
    noise = s2v[:, :, None] * np.eye(n) + s2v0[:, None, None] + LEAST_VARIANCE * np.eye(n)
    weighed = np.linalg.solve(noise, np.broadcast_to(a, (f, n, n + 1)))
    covariance = np.linalg.inv(np.eye(n + 1) / spread[:, :, None] + a.T @ weighed)
    covariance = (covariance + covariance.transpose(0, 2, 1)) / 2
    mean = np.einsum("fij,fkj,fk->fi", covariance, weighed, r)
    factor = _factors(covariance)
    # The orthant itself, and the ones that the density times exp(-u_k) moves it to.
    moved = np.concatenate([mean[:, None], mean[:, None] - covariance], axis=1)
    logs = log_orthants(moved, np.broadcast_to(factor[:, None], (f, n + 2, n + 1, n + 1)), uniform)
    out = 0.5 * np.einsum("fkk->fk", covariance) - mean + logs[:, 1:] - logs[:, :1]
    return np.where(np.isnan(factor[:, :1, 0]), np.nan, np.clip(np.exp(out), 0, 1))


def firm_efficiencies(r: np.ndarray, s2u0: float, s2v0: float, s2u: np.ndarray, s2v: np.ndarray, s: int, uniform: np.ndarray) -> np.ndarray:
    """exp(-u_i0), then exp(-u_it) for each period, expected given one firm's composed errors; NaN where no factor exists."""
    return _equal_firms(r[None], np.array([s2u0]), np.array([s2v0]), s2u[None], s2v[None], s, uniform)[0]


def block_efficiencies(block: FR.Block, theta: np.ndarray, model: FR.Frontier, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(persistent, transient) efficiency of each row of a block of whole firms."""
    part, starts = model.split(theta), block["starts"]
    r = block["y"] - block["x"] @ part["x"]
    s2u, s2v = np.exp(block["zuit"] @ part["zuit"]), np.exp(block["zvit"] @ part["zvit"])
    s2v0 = np.exp(block["zvi0"][starts] @ part["zvi0"])
    s2u0 = np.exp(block["zui0"][starts] @ part["zui0"]) if model.persistent else np.zeros(len(starts))
    sizes = np.diff(np.append(starts, len(r)))
    persistent, transient = np.empty(len(r)), np.empty(len(r))
    for n in np.unique(sizes):
        firms = np.flatnonzero(sizes == n)
        most = max(1, BLOCK_CELLS // ((int(n) + 2) * (int(n) + 1) * uniform.shape[1]))
        for at in range(0, len(firms), most):
            some = firms[at : at + most]
            rows = starts[some][:, None] + np.arange(n)
            found = _equal_firms(r[rows], s2u0[some], s2v0[some], s2u[rows], s2v[rows], model.s, uniform)
            persistent[rows], transient[rows] = found[:, :1], found[:, 1:]
    return persistent, transient


def _checked(model: FR.Frontier) -> None:
    if model.distribution != "half" or model.effect in ("fixed", "none"):
        raise ValueError("the efficiencies are of half-normal models with a random effect")


def efficiencies(panel: DataFrame, theta: np.ndarray, model: FR.Frontier, draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """id, time, persistent, transient and overall efficiency of each row of panel(id, time, ...).

    Without a persistent inefficiency in the model its variance is next to zero, and the persistent efficiency next to 1. Rows
    that the model leaves out have no row here; join on (id, time).
    """
    _checked(model)
    rows = FR.prepared(panel, model)
    kinds = dict(rows.dtypes)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uniform = np.empty((0, draws))
        for block in FR._firm_blocks(batches, model):
            uniform = _enough(uniform, block, draws, seed)
            persistent, transient = block_efficiencies(block, theta, model, uniform)
            columns = [block["id"].combine_chunks(), block["time"].combine_chunks(), *map(pa.array, (persistent, transient, persistent * transient))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "time", "persistent", "transient", "overall"])

    return rows.mapInArrow(kernel, f"id {kinds['id']}, time {kinds['time']}, persistent double, transient double, overall double")


def _enough(uniform: np.ndarray, block: FR.Block, draws: int, seed: int) -> np.ndarray:
    """Draws for the block's longest firm: those there are, or more of them."""
    longest = int(np.diff(np.append(block["starts"], len(block["y"]))).max())
    return uniform if longest + 1 <= len(uniform) else uniform_draws(longest + 1, draws, seed)


def class_efficiencies(panel: DataFrame, theta: np.ndarray, model: MX.Mixture, draws: int | None = None, seed: int = 1) -> DataFrame:
    """id, time, persistent, transient and overall efficiency, weighted by the firm's posteriors, and transient_<k> in each class.

    draws: 20 for each draw of the likelihood by default. Rows that the model leaves out have no row here.
    """
    _checked(model.frontier)
    draws = 20 * model.frontier.draws if draws is None else draws
    rows = FR.prepared(panel, model)
    kinds, each = dict(rows.dtypes), [f"transient_{c + 1}" for c in range(model.classes)]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uniform = np.empty((0, draws))
        for block in FR._firm_blocks(batches, model):
            uniform, thetas, kept = _enough(uniform, block, draws, seed), model.parts(theta)[1], {}
            paths = [FR.Paths(block, t, model.frontier, kept) for t in thetas]
            posterior = paths[0].spread(model.joined(block, theta, [p.loglik for p in paths])[2])
            found = [block_efficiencies(block, t, model.frontier, uniform) for t in thetas]
            persistent, transient = (sum(posterior[:, c] * f[k] for c, f in enumerate(found)) for k in (0, 1))
            values = [persistent, transient, sum(posterior[:, c] * p * t for c, (p, t) in enumerate(found)), *(f[1] for f in found)]
            yield pa.RecordBatch.from_arrays([block["id"].combine_chunks(), block["time"].combine_chunks(), *map(pa.array, values)], names=["id", "time", "persistent", "transient", "overall", *each])

    return rows.mapInArrow(kernel, ", ".join([f"id {kinds['id']}", f"time {kinds['time']}", *(f"{c} double" for c in ("persistent", "transient", "overall", *each))]))
