"""Frontiers by maximum likelihood: cross-sections, and panels with random firm effects by draws or by quadrature.

y_it = x_it'b + v_i0 + v_it - s (u_it [+ u_i0]); u half-normal or truncated normal, v normal, log-variances and the mean before
truncation linear in determinants. v_i0 is random, absent, or fixed for each firm and then concentrated out of the likelihood:
each firm's is found where the firm's rows lie, so no column is made for a firm. The panel is dealt by firm once and kept. An evaluation is one job for any number of parameter vectors: each task works through the firms of
its partition in blocks and emits sums, which are added before and after a shuffle of a few hundred numbers. The steps of the
search are small dense algebra on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.special import log_ndtr, log_ndtr_mills, mills, ndtri, t_quantile, t_sf
from fathomline.operators.optimise import CURVED, GRADIENT, OUTER, VALUE, Ask, Found, Options, Sums, lockstep, search
from fathomline.operators.panel import check_time_invariant, complete_cases, factorize, quoted, within
from fathomline.operators.regression import moment_split, moments, regression

#: Cells (rows times draws) that a task holds at a time; one firm's rows stay together.
BLOCK_CELLS = 400_000
#: Cells that are worth a task of their own; a task costs the engine as much as the sums over a few thousand rows.
TASK_CELLS = 20_000_000
ROOT_TWO_OVER_PI = math.sqrt(2 / math.pi)
#: Log-variances below the first are tried at the second, where they make no difference, when a search has become slow.
NEARLY_ZERO, ZERO = -7.0, -25.0
#: The last terms of a series over a firm's draws must be below this share of its largest; else it gets more terms. A third of them
#: where derivatives are wanted too, whose terms fall as fast but begin higher, and an eighth for the density alone.
SERIES_TOLERANCE, LEAST_TERMS = 1e-13, 6
#: Draws that a series is summed over at a time, and how far from the real line the normal distribution function has its first zero.
SERIES_DRAWS, FIRST_ZERO = 16_000, 2.8


Block = dict[str, np.ndarray]


@dataclass(frozen=True)
class Frontier:
    """Columns and settings of a model; persistent adds u_i0. x gets an intercept, every determinant list a constant."""

    y: str
    x: Sequence[str]
    zuit: Sequence[str] = ()
    zvit: Sequence[str] = ()
    zvi0: Sequence[str] = ()
    zui0: Sequence[str] = ()
    persistent: bool = False
    s: int = 1
    draws: int = 500
    burn_in: int = 1000
    bases: tuple[int, int] = (2, 3)
    #: What becomes of v_i0: integrated out by "halton" draws, or by "quadrature" with adaptive Gauss-Hermite nodes; "fixed", a
    #: parameter of each firm in place of the intercept; or "none" without it.
    effect: str = "halton"
    nodes: int = 15
    #: Digits of the draws permuted at random by the seed; without, the plain sequence.
    scrambled: bool = True
    #: The numbers of the whole sequence dealt to the firms' draws in a random order, by a bijection of their places.
    shuffled: bool = False
    seed: int = 1
    #: Law of u_it: "half" normal, or normal "truncated" at zero, with a mean before that which depends on mu.
    distribution: str = "half"
    mu: Sequence[str] = ()
    #: Whether x has a constant; never beside fixed effects.
    intercept: bool = True

    def __post_init__(self):
        if self.effect not in ("halton", "quadrature", "fixed", "none") or self.persistent and self.effect != "halton":
            raise ValueError("effect must be halton, quadrature, fixed or none, and halton with a persistent inefficiency")
        if self.distribution not in ("half", "truncated") or self.mu and self.distribution != "truncated":
            raise ValueError("distribution must be half or truncated, and truncated with determinants mu")
        if self.nodes not in (7, 10, 15, 20):
            raise ValueError("nodes must be 7, 10, 15 or 20")
        if self.s not in (1, -1):
            raise ValueError("s must be 1 (production) or -1 (cost)")
        if self.draws < 1:
            raise ValueError("draws must be >= 1")
        if self.burn_in < 0:
            raise ValueError("burn_in must be >= 0")
        if any(b < 2 or any(b % d == 0 for d in range(2, math.isqrt(b) + 1)) for b in self.bases):
            raise ValueError("the bases must be prime")
        if self.zui0 and not self.persistent:
            raise ValueError("zui0 needs a persistent inefficiency")
        if self.zvi0 and self.effect in ("fixed", "none"):
            raise ValueError("zvi0 needs a random firm effect")
        if not self.x and not self.constant():
            raise ValueError("the frontier has no columns")
        if self.bases[0] == self.bases[1]:
            raise ValueError("the bases of the two draw sequences must differ")

    def blocks(self) -> dict[str, Sequence[str]]:
        out = {"x": self.x, "zuit": self.zuit, "zvit": self.zvit}
        out |= {"mu": self.mu} if self.distribution == "truncated" else {}
        out |= {"zvi0": self.zvi0} if self.effect in ("halton", "quadrature") else {}
        return out | {"zui0": self.zui0} if self.persistent else out

    def sizes(self) -> dict[str, int]:
        """Parameters of each block: a constant and its columns, but x has none beside fixed effects."""
        return {b: len(cols) + (b != "x" or self.constant()) for b, cols in self.blocks().items()}

    def constant(self) -> bool:
        return self.intercept and self.effect != "fixed"

    def terms(self) -> list[str]:
        return [*(("_cons", *self.x) if self.constant() else self.x), *(f"{b.capitalize()}_{c}" for b, cols in self.blocks().items() if b != "x" for c in ("cons", *cols))]

    def columns(self) -> list[str]:
        return [self.y, *dict.fromkeys(c for cols in self.blocks().values() for c in cols)]

    def firm_columns(self) -> list[str]:
        """Determinants of firm effects, which may not vary within a firm."""
        return [c for b, cols in self.blocks().items() if b in ("zvi0", "zui0") for c in cols]

    def width(self) -> int:
        """Draws or nodes of a row."""
        return {"halton": self.draws, "quadrature": self.nodes}.get(self.effect, 1)

    def value(self, block: Block, theta: np.ndarray, kept: dict, tag: int = 0) -> np.ndarray:
        return Paths(block, theta, self, kept, only_value=True).loglik

    def scores(self, block: Block, theta: np.ndarray, kept: dict, tag: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return firm_scores(block, theta, self, kept)

    def curvature(self, block: Block, theta: np.ndarray, kept: dict, tag: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        loglik, score, hessian = firm_curvature(block, theta, self, kept)
        return loglik, score, hessian, hessian

    def jumps(self, theta: np.ndarray) -> list[np.ndarray]:
        """theta with one or all of the small variances as good as zero, the intercept moved by the mean inefficiency that is lost."""
        terms, sizes = self.terms(), self.sizes()
        first = dict(zip(sizes, np.concatenate([[0], np.cumsum(list(sizes.values()))[:-1]])))
        small = [b for b in ("zuit", "zui0", "zvi0") if b in sizes and theta[first[b]] < NEARLY_ZERO and theta[first[b]] > ZERO + 1]
        out = []
        for chosen in ([b] for b in small) if len(small) < 2 else (*([b] for b in small), small):
            moved = theta.copy()
            for b in chosen:
                moved[first[b] : first[b] + sizes[b]] = 0.0
                moved[first[b]] = ZERO
                if b != "zvi0" and terms[0] == "_cons" and self.distribution == "half":
                    moved[0] -= self.s * ROOT_TWO_OVER_PI * math.exp(0.5 * theta[first[b]])
            out.append(moved)
        return out

    def split(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        sizes = self.sizes()
        return dict(zip(sizes, np.split(theta, np.cumsum(list(sizes.values()))[:-1])))


def prepared(panel: DataFrame, model: Frontier, n_rows: int | None = None) -> DataFrame:
    """Complete cases of panel(id, time, ...) with the model's blocks as arrays, dealt by firm; rank numbers the firms.

    Without a firm effect every row is a firm of its own, and rank a hash of it. The number of partitions is stated, as the work is in the likelihood,
    not in the rows' size, by which they would be coalesced to a few. n_rows, if known: no more partitions
    than two for each core, or as many for each as the work is worth.
    """
    spark = panel.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if n_rows is not None:
        parts = min(parts, cores * max(2, math.ceil(n_rows * model.width() / TASK_CELLS / cores)))
    number = lambda c: F.col(quoted(c)).cast("double")
    constant = lambda b, cols: [F.lit(1.0)] if model.sizes()[b] > len(cols) else []
    blocks = [F.array(*constant(b, cols), *map(number, cols)).cast("array<double>").alias(b) for b, cols in model.blocks().items()]
    rows = complete_cases(panel, model.columns())
    if model.effect == "none":
        for c in ("id", "time"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("long"))
        rows = rows.select("id", "time", number(model.y).alias("y"), *blocks)
        return rows.select(F.xxhash64(*rows.columns).alias("rank"), "*").repartition(parts)
    rows = factorize(rows, "id", "rank")
    if model.effect == "halton" and model.shuffled:
        blocks.append(F.array(F.col("firms").cast("double")).alias("firms"))
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("rank").alias("firms"))))  # one row
    return rows.select("rank", "id", "time", number(model.y).alias("y"), *blocks).repartition(parts, "rank").sortWithinPartitions("rank", "time")


@lru_cache(maxsize=64)
def inverses(base: int, places: int, digits: tuple[int, ...]) -> np.ndarray:
    """Radical inverses of all numbers of so many digits of the base, each replaced by that of digits."""
    out, scale = np.zeros(1), 1.0
    for _ in range(places):
        scale /= base
        out = (out[None, :] + scale * np.array(digits, float)[:, None]).ravel()
    return out


def halton(index: np.ndarray, base: int, digits: np.ndarray | None = None) -> np.ndarray:
    """Radical inverse of positive indices, within 1e-12 of neither end; digits: a permutation of those of the base.

    With a permutation the zeros before an index's first digit count too, as many as doubles can tell. Digits are looked up several at a time.
    """
    out, rest, done = np.zeros(index.shape), index, 0
    several, most = max(1, int(12 / math.log2(base))), 0
    while float(base) ** -(most + 1) > 1e-16:
        most += 1
    each = tuple(range(base)) if digits is None else tuple(map(int, digits))
    while rest.any() if digits is None else done < most:
        places = several if digits is None else min(several, most - done)
        above = rest // base**places
        out += float(base) ** -done * inverses(base, places, each)[rest - above * base**places]
        rest, done = above, done + places
    return np.clip(out, 1e-12, 1 - 1e-12)


def mixed(x: np.ndarray, *keys: int) -> np.ndarray:
    """64-bit hashes of x, an array of unsigned longs, under keys."""
    with np.errstate(over="ignore"):
        for key in (0, *keys):
            x = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x = x ^ x >> np.uint64(31)
    return x


def shuffled_places(places: np.ndarray, n: int, *keys: int) -> np.ndarray:
    """Where each place of 0..n-1 goes under a random order that the keys fix; no array of n numbers is made.

    Four rounds of a balanced network permute a power of four; what falls outside n goes round again.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    x = places.astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in range(4):
            left, right = right, left ^ mixed(right, k, *keys) & low
        return left << half | right

    x = once(x)
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def sequence_places(ranks: np.ndarray, model: Frontier, base: int, firms: int = 0) -> np.ndarray:
    """(firms, draws) places in the sequence: the part that belongs to a firm's rank, so reruns agree on any partitioning.

    firms: how many there are, for a model with shuffled draws.
    """
    at = (ranks[:, None] - 1) * model.draws + np.arange(model.draws)[None, :]
    return (shuffled_places(at, firms * model.draws, model.seed, base) if model.shuffled else at) + model.burn_in + 1


def scrambled_digits(model: Frontier, base: int) -> np.ndarray | None:
    return np.random.default_rng([model.seed, base]).permutation(base) if model.scrambled else None


def normal_draws(ranks: np.ndarray, model: Frontier, base: int, firms: int = 0) -> np.ndarray:
    """A row of normal draws for each firm."""
    return ndtri(halton(sequence_places(ranks, model, base, firms), base, scrambled_digits(model, base)))


def uniform_rows(firms: DataFrame, model: Frontier, base: int) -> DataFrame:
    """The columns of firms(rank, ...), r from 0 and u: the model's uniform numbers for each firm, before they are made normal."""
    names = firms.columns
    n = int(firms.agg(F.max("rank")).first()[0] or 0) if model.shuffled else 0

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = sequence_places(batch.column("rank").to_numpy(), model, base, n)
            taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), model.draws)))
            u = halton(at, base, scrambled_digits(model, base))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.tile(np.arange(model.draws), batch.num_rows)), pa.array(u.ravel())], names=[*names, "r", "u"])

    return firms.mapInArrow(kernel, ", ".join([*(f"`{c}` {t}" for c, t in firms.dtypes), "r long", "u double"]))


def _firm_blocks(batches: Iterable[pa.RecordBatch], model: Frontier) -> Iterator[Block]:
    """Whole firms at a time; batches are sorted by rank, and a firm may go on in the next batch."""
    sizes, most, alone = model.sizes(), max(1, BLOCK_CELLS // model.width()), model.effect == "none"
    by_firm = getattr(model, "by_firm", ())  # arrays that a firm's first row has, and no other

    def arrays(table: pa.Table) -> Block:
        out = {"rank": table["rank"].to_numpy(), "y": table["y"].to_numpy(), "id": table["id"], "time": table["time"]}
        for b, size in sizes.items():
            out[b] = table[b].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(out["y"]), size)
        out["starts"] = np.arange(len(out["y"])) if alone else np.flatnonzero(np.append(True, out["rank"][1:] != out["rank"][:-1]))
        for b in by_firm:
            out[b] = table[b].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(out["starts"]), -1)
        if "firms" in table.column_names:
            out["firms"] = table["firms"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return out

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if alone:
            yield arrays(pa.Table.from_batches([batch]))
            continue
        rest.append(batch)
        if sum(b.num_rows for b in rest) < most:
            continue
        table = pa.Table.from_batches(rest)
        ranks = table["rank"].to_numpy()
        starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
        last, at = int(starts[-1]), 0
        while at < last:
            end = int(starts[max(np.searchsorted(starts, min(at + most, last), "right") - 1, np.searchsorted(starts, at, "right"))])
            yield arrays(table.slice(at, end - at))
            at = end
        rest = table.slice(last).to_batches()
    if rest:
        yield arrays(pa.Table.from_batches(rest))


def log_half_normal(e: np.ndarray, s2u: np.ndarray, s2v: np.ndarray, s: int, log_cdf: Callable[[np.ndarray], np.ndarray] = log_ndtr) -> tuple[np.ndarray, np.ndarray]:
    """Log density of composed errors, and the argument of its distribution function."""
    s2 = s2u + s2v
    w = -s * e * np.sqrt(s2u / (s2v * s2))
    return math.log(2) - 0.5 * math.log(2 * math.pi) - 0.5 * np.log(s2) - 0.5 * e * e / s2 + log_cdf(w), w


def log_truncated_normal(e: np.ndarray, mu: np.ndarray, s2u: np.ndarray, s2v: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a normal law with mean mu before it is cut at zero."""
    s2 = s2u + s2v
    w = (mu * s2v - s * e * s2u) / np.sqrt(s2 * s2u * s2v)
    return -0.5 * math.log(2 * math.pi) - 0.5 * np.log(s2) - 0.5 * (e + s * mu) ** 2 / s2 + log_ndtr(w) - log_ndtr(mu / np.sqrt(s2u)), w


def truncated_slopes(e: np.ndarray, mu: np.ndarray, s2u: np.ndarray, s2v: np.ndarray, s: int) -> tuple[dict, dict]:
    """First and second derivatives of that by e, mu and the two log-variances.

    The log density is g(q) + log Phi(w) - log Phi(c), with q = e + s mu, w = a + b, a linear in e and b in mu, and c = mu / sigma_u.
    """
    s2 = s2u + s2v
    pu, pv = s2u / s2, s2v / s2
    cross, q, k, h, root = pu * pv, e + s * mu, np.sqrt(s2u / (s2v * s2)), np.sqrt(s2v / (s2u * s2)), np.sqrt(s2u)
    a, b, c = -s * e * k, mu * h, mu / root
    w = a + b
    m, n = mills(w), mills(c)
    square = q * q / s2
    au, av, bu, bv = 0.5 * pv, -0.5 * (1 + pv), -0.5 * (1 + pu), 0.5 * pu
    w1 = {"e": -s * k, "mu": h, "zuit": a * au + b * bu, "zvit": a * av + b * bv}
    c1 = {"mu": 1 / root, "zuit": -0.5 * c}
    g1 = {"e": -q / s2, "mu": -s * q / s2, "zuit": 0.5 * pu * (square - 1), "zvit": 0.5 * pv * (square - 1)}
    w2 = {
        ("e", "zuit"): -s * k * au, ("e", "zvit"): -s * k * av, ("mu", "zuit"): h * bu, ("mu", "zvit"): h * bv,
        ("zuit", "zuit"): a * au * au + b * bu * bu - 0.5 * cross * w, ("zuit", "zvit"): a * au * av + b * bu * bv + 0.5 * cross * w,
        ("zvit", "zvit"): a * av * av + b * bv * bv - 0.5 * cross * w,
    }
    c2 = {("mu", "zuit"): -0.5 / root, ("zuit", "zuit"): 0.25 * c}
    g2 = {
        ("e", "e"): -1 / s2, ("e", "mu"): -s / s2, ("mu", "mu"): -1 / s2, ("e", "zuit"): q * pu / s2, ("e", "zvit"): q * pv / s2,
        ("mu", "zuit"): s * q * pu / s2, ("mu", "zvit"): s * q * pv / s2, ("zuit", "zuit"): -0.5 * cross + 0.5 * square * (cross - pu * pu),
        ("zuit", "zvit"): 0.5 * cross - square * cross, ("zvit", "zvit"): -0.5 * cross + 0.5 * square * (cross - pv * pv),
    }
    first = {v: g1[v] + m * w1[v] - n * c1.get(v, 0.0) for v in g1}
    bend_w, bend_c = -m * (w + m), -n * (c + n)
    second = {
        (x, y): g2[x, y] + m * w2.get((x, y), 0.0) + bend_w * w1[x] * w1[y] - n * c2.get((x, y), 0.0) - bend_c * c1.get(x, 0.0) * c1.get(y, 0.0)
        for x, y in g2
    }
    return first, second


def adaptive_nodes(paths: Callable[[np.ndarray], np.ndarray], firms: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, log weights) of each firm for the integral of exp(paths(v)) over a standard normal v.

    The nodes are set about the mode, found by ten damped Newton steps on differences, and as wide as the curve is there.
    """
    step, mode = 1e-3, np.zeros((firms, 1))
    for k in range(11):
        mid, up, down = (paths(mode + d) - 0.5 * (mode + d) ** 2 for d in (0.0, step, -step))
        curve = (up - 2 * mid + down) / step**2
        if k < 10:
            mode = mode + np.clip((up - down) / (2 * step) / np.maximum(-curve, 0.01), -2, 2)
    width = np.maximum(1 / np.sqrt(np.maximum(-curve, 0.01)), 0.1)
    at, weight = np.polynomial.hermite.hermgauss(nodes)
    v = mode + width * math.sqrt(2) * at
    return v, np.log(weight) - 0.5 * math.log(math.pi) + at**2 - 0.5 * v * v + np.log(width)


@lru_cache(maxsize=64)
def chebyshev(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n points of [-1, 1], and the matrix that makes of values there the terms of their Chebyshev series."""
    angle = math.pi * (np.arange(n) + 0.5) / n
    terms = 2 / n * np.cos(np.arange(n)[:, None] * angle)
    terms[0] /= 2
    return np.cos(angle), terms


def chebyshev_polynomials(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out, (firms, n, draws): the first n polynomials at x."""
    out[:, 0], out[:, 1] = 1.0, x
    twice = 2 * x
    for k in range(2, out.shape[1]):
        np.multiply(twice, out[:, k - 1], out=out[:, k])
        out[:, k] -= out[:, k - 2]
    return out


class Paths:
    """What a firm's likelihood and its derivatives need at one parameter vector, for each row and draw.

    Over one sequence of draws, a firm's log density and its derivatives are smooth functions of the draw alone. Where a Chebyshev series has them
    to the last digits, they are found at a few nodes in place of the draws, and the draws' weights become weights of the nodes: all draws
    are summed over, and sums over the nodes are those over the draws. These weights may be negative. only_value: loglik alone is wanted.
    """

    def __init__(self, block: Block, theta: np.ndarray, model: Frontier, kept: dict, only_value: bool = False):
        part, self.starts = model.split(theta), block["starts"]
        self.sizes = np.diff(np.append(self.starts, len(block["y"])))
        self.s2u, self.s2v = np.exp(block["zuit"] @ part["zuit"])[:, None], np.exp(block["zvit"] @ part["zvit"])[:, None]
        self.s, self.mu = model.s, (block["mu"] @ part["mu"])[:, None] if "mu" in part else None
        e = (block["y"] - block["x"] @ part["x"])[:, None]
        self.move0, self.move1, self.ratio, log_weights = None, None, None, np.zeros((len(self.starts), 1))
        if model.effect == "fixed":
            self.fixed = self.firm_effects(e)
            e = e - self.spread(self.fixed)
        elif model.effect != "none":
            sd = np.exp(0.5 * (block["zvi0"][self.starts] @ part["zvi0"]))[:, None]
            if model.effect == "halton":
                if "draws" not in kept:  # they depend on the firm alone
                    ranks, firms = block["rank"][self.starts], int(block["firms"][0]) if model.shuffled else 0
                    kept["draws"] = [normal_draws(ranks, model, model.bases[0], firms), np.abs(normal_draws(ranks, model, model.bases[1], firms)) if model.persistent else None]
                v, log_weights = kept["draws"][0], np.full((1, 1), -math.log(model.draws))
            else:
                firm = lambda v: self.spread(sd * v)
                v, log_weights = kept["nodes"] if "nodes" in kept else adaptive_nodes(lambda v: self.by_firm(self.density(e - firm(v))[0]), len(self.starts), model.nodes)
            self.nodes = v, log_weights
            if model.effect == "halton" and not model.persistent and self.condensed(e, sd, v, only_value):
                return
            self.move0 = self.spread(sd * v)
            e = e - self.move0
            if model.persistent:
                self.move1 = self.spread(np.exp(0.5 * (block["zui0"][self.starts] @ part["zui0"]))[:, None] * kept["draws"][1])
                e = e + model.s * self.move1
        self.e = e
        log_f, self.w = self.density(e)
        paths = self.by_firm(log_f) + log_weights
        top = paths.max(axis=1, keepdims=True)
        weights = np.exp(paths - top)
        total = weights.sum(axis=1, keepdims=True)
        self.loglik = (top + np.log(total))[:, 0]
        self.by_draw = weights / total
        self.q = self.spread(self.by_draw)

    def condensed(self, e: np.ndarray, sd: np.ndarray, v: np.ndarray, only_value: bool) -> bool:
        """Whether a series of fewer than half as many terms as there are draws was found; then everything is set that is wanted."""
        low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
        middle, half = (low + high) / 2, (high - low) / 2
        reach = float((self.spread(half * sd) * np.sqrt(self.s2u / (self.s2v * (self.s2u + self.s2v)))).max()) / FIRST_ZERO
        if not 0 < reach < v.shape[1]:
            return False
        share = 8 if only_value else 3
        n = max(LEAST_TERMS, math.ceil(share / (share - 1) * -math.log(SERIES_TOLERANCE) / math.asinh(1 / reach)))
        while 2 * n < v.shape[1]:
            at, to_terms = chebyshev(n)
            move = self.spread(sd * (middle + half * at))
            log_f, w = self.density(e - move, smooth=True)
            terms = self.by_firm(log_f) @ to_terms.T
            left = float((np.abs(terms[:, n - max(2, n // share) :]).max(axis=1) / (1 + np.abs(terms).max(axis=1))).max())
            if left <= SERIES_TOLERANCE:
                break
            n = math.ceil(n * max(1.2, math.log(SERIES_TOLERANCE) / math.log(left))) if left < 0.1 else v.shape[1]
        else:
            self.ratio = None
            return False
        self.move0, self.e, self.w, self.loglik, sums = move, e - move, w, np.empty(len(v)), np.empty((len(v), n))
        step = max(1, SERIES_DRAWS // v.shape[1])
        held = np.empty((min(step, len(v)), n, v.shape[1]))
        for k in range(0, len(v), step):
            some = slice(k, k + step)
            polynomials = chebyshev_polynomials((v[some] - middle[some]) / half[some], held[: len(v) - k])
            paths = np.matmul(terms[some, None, :], polynomials)[:, 0]
            top = paths.max(axis=1, keepdims=True)
            weights = np.exp(paths - top)
            total = weights.sum(axis=1, keepdims=True)
            self.loglik[some] = (top + np.log(total))[:, 0] - math.log(v.shape[1])
            if not only_value:
                sums[some] = np.matmul(polynomials, (weights / total)[:, :, None])[:, :, 0]
        if not only_value:
            self.by_draw = sums @ to_terms
            self.q = self.spread(self.by_draw)
        return True

    def spread(self, firms: np.ndarray) -> np.ndarray:
        return np.repeat(firms, self.sizes, axis=0)

    def by_firm(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows, self.starts, axis=0)

    def density(self, e: np.ndarray, smooth: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Log density and the argument of its distribution function; smooth: to the last digits, where a half-normal law allows that."""
        if self.mu is not None:
            return log_truncated_normal(e, self.mu, self.s2u, self.s2v, self.s)
        if not smooth:
            return log_half_normal(e, self.s2u, self.s2v, self.s)
        rest, w = log_half_normal(e, self.s2u, self.s2v, self.s, np.zeros_like)
        log_phi, self.ratio = log_ndtr_mills(w)
        return rest + log_phi, w

    def firm_effects(self, e: np.ndarray, most_steps: int = 100) -> np.ndarray:
        """The effect of each firm at which its rows are likeliest: Newton steps, as the log density is concave in e."""
        sd = np.sqrt(np.maximum.reduceat(self.s2u + self.s2v, self.starts, axis=0))
        at = self.by_firm(e + self.s * ROOT_TWO_OVER_PI * np.sqrt(self.s2u)) / self.sizes[:, None]
        for _ in range(most_steps):
            self.e = e - self.spread(at)
            self.w = self.density(self.e)[1]
            first, second = self.derivatives(only_e=True)
            step = np.clip(self.by_firm(first["e"]) / self.by_firm(second["e", "e"]), -sd, sd)
            at = at + step
            if np.abs(step).max(initial=0) <= 1e-12 * (1 + np.abs(at).max(initial=0)):
                break
        return at

    def inefficiency(self) -> tuple[np.ndarray, np.ndarray]:
        """E[u | e] and E[exp(-u) | e] of each row, averaged over its draws."""
        s2 = self.s2u + self.s2v
        mu, sd = (-self.s * self.e * self.s2u + (0.0 if self.mu is None else self.mu * self.s2v)) / s2, np.sqrt(self.s2u * self.s2v / s2)
        m = mu / sd
        return (self.q * (mu + sd * mills(m))).sum(axis=1), (self.q * np.exp(-mu + 0.5 * sd * sd + log_ndtr(m - sd) - log_ndtr(m))).sum(axis=1)

    def derivatives(self, only_e: bool = False, curved: bool = True) -> tuple[dict, dict]:
        """First and second derivatives of the log density by e, mu and the log-variances; only_e: at least those by e."""
        if self.mu is not None:
            return truncated_slopes(self.e, self.mu, self.s2u, self.s2v, self.s)
        s, w, e = self.s, self.w, self.e
        fe, fa, fb, m, s2, pu, pv, k, ka, kb = self.slopes(s)
        first = {"e": fe, "zuit": fa, "zvit": fb}
        if not curved:
            return first, {}
        bend = -m * (w + m)
        second = {("e", "e"): -1 / s2 + bend * k * k}
        if only_e:
            return first, second
        mixed, square, cross = m + bend * w, e * e / s2, pu * pv
        return first, second | {
            ("e", "zuit"): e * pu / s2 - s * k * ka * mixed, ("e", "zvit"): e * pv / s2 - s * k * kb * mixed,
            ("zuit", "zuit"): -0.5 * cross + 0.5 * square * (cross - pu * pu) + w * (ka * ka * mixed - 0.5 * m * cross),
            ("zuit", "zvit"): 0.5 * cross - square * cross + w * (ka * kb * mixed + 0.5 * m * cross),
            ("zvit", "zvit"): -0.5 * cross + 0.5 * square * (cross - pv * pv) + w * (kb * kb * mixed - 0.5 * m * cross),
        }

    def slopes(self, s: int) -> tuple[np.ndarray, ...]:
        """Derivatives of the half-normal log density by e and the two log-variances; the Mills ratio and shared factors."""
        s2 = self.s2u + self.s2v
        pu, pv, k = self.s2u / s2, self.s2v / s2, np.sqrt(self.s2u / (self.s2v * s2))
        ka, kb, m = 0.5 * pv, -0.5 * (1 + pv), mills(self.w) if self.ratio is None else self.ratio
        half = 0.5 * self.e * self.e / s2 - 0.5
        return -self.e / s2 - s * k * m, half * pu + m * self.w * ka, half * pv + m * self.w * kb, m, s2, pu, pv, k, ka, kb

    def effects(self, model: Frontier) -> dict[str, np.ndarray | float]:
        """By how much e moves with each block's linear term."""
        out: dict[str, np.ndarray | float] = {"x": -1.0}
        if self.move0 is not None:
            out["zvi0"] = -0.5 * self.move0
        if self.move1 is not None:
            out["zui0"] = 0.5 * model.s * self.move1
        return out


def firm_scores(block: Block, theta: np.ndarray, model: Frontier, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and score of each firm of a block."""
    p = Paths(block, theta, model, {} if kept is None else kept)
    first = p.derivatives(curved=False)[0]
    moves = p.effects(model)
    rows = {b: (p.q * (first["e"] * moves[b] if b in moves else first[b])).sum(axis=1) for b in model.blocks()}
    return p.loglik, p.by_firm(np.hstack([block[b] * rows[b][:, None] for b in model.blocks()]))


def firm_curvature(block: Block, theta: np.ndarray, model: Frontier, kept: dict | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and score of each firm, and the sum of the firms' Hessians, times their weight if given.

    A firm's Hessian is the mean over its draws of each path's Hessian and of its score's outer product, less that of the mean score.
    """
    p = Paths(block, theta, model, {} if kept is None else kept)
    first, second = p.derivatives()
    fe = first["e"]
    weight = np.ones(len(p.starts)) if weight is None else weight
    q = p.q * p.spread(weight[:, None])
    moves, blocks = p.effects(model), list(model.blocks())
    inner_of = lambda b: "e" if b in moves else b
    place = np.concatenate([[0], np.cumsum([block[b].shape[1] for b in blocks])])
    hessian = np.zeros((place[-1], place[-1]))
    for i, a in enumerate(blocks):
        for j, b in enumerate(blocks[: i + 1]):
            inner = inner_of(a), inner_of(b)
            curve = second.get(inner, second.get(inner[::-1])) * moves.get(a, 1.0) * moves.get(b, 1.0)
            if a == b and a != "x" and a in moves:
                curve = curve + 0.5 * fe * moves[a]
            part = block[a].T @ (block[b] * (q * curve).sum(axis=1)[:, None])
            hessian[place[i] : place[i + 1], place[j] : place[j + 1]] = part
            hessian[place[j] : place[j + 1], place[i] : place[i + 1]] = part.T
    # Scores of every firm and draw, one parameter at a time.
    slope = {b: fe * moves[b] if b in moves else first[b] for b in blocks}
    paths = np.stack([p.by_firm(slope[b] * block[b][:, [c]]) * np.ones((1, p.by_draw.shape[1])) for b in blocks for c in range(block[b].shape[1])])
    score = np.einsum("pir,ir->ip", paths, p.by_draw)
    if model.effect == "fixed":  # the effects follow the other parameters
        bend = lambda b: second.get((inner_of(b), "e"), second.get(("e", inner_of(b)))) * -moves.get(b, 1.0)
        with_effect = np.hstack([p.by_firm(block[b] * bend(b)) for b in blocks])
        hessian -= (with_effect * (weight[:, None] / p.by_firm(second["e", "e"]))).T @ with_effect
    weighted = (paths * (p.by_draw * weight[:, None])).reshape(len(paths), -1)
    return p.loglik, score, hessian + weighted @ paths.reshape(len(paths), -1).T - (score * weight[:, None]).T @ score


def row_scores(block: Block, theta: np.ndarray, model: Frontier, kept: dict | None = None) -> np.ndarray:
    """The score of each row: its part of the firm's, averaged over the firm's draws by their weight."""
    p = Paths(block, theta, model, {} if kept is None else kept)
    first = p.derivatives(curved=False)[0]
    moves = p.effects(model)
    return np.hstack([block[b] * (p.q * (first["e"] * moves[b] if b in moves else first[b])).sum(axis=1)[:, None] for b in model.blocks()])


def evaluate_asks(rows: DataFrame, asks: Sequence[Ask], model: Frontier) -> list[Sums]:
    """What each ask wants to know, in one job: tasks emit sums, which are added before and after a shuffle of a few hundred numbers."""
    widths = [1 + (a.level >= GRADIENT) * len(a.theta) + (0, 0, 1, 3)[a.level] * len(a.theta) ** 2 for a in asks]
    ends = np.cumsum(widths)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(int(ends[-1]))
        for block in _firm_blocks(batches, model):
            kept: dict = {}
            for ask, width, end in zip(asks, widths, ends):
                if ask.level == VALUE:
                    found = [[model.value(block, ask.theta, kept, ask.tag).sum()]]
                else:
                    loglik, score, *hessians = (model.curvature if ask.level == CURVED else model.scores)(block, ask.theta, kept, ask.tag)
                    found = [[loglik.sum()], score.sum(axis=0)] + ([(score.T @ score).ravel()] if ask.level >= OUTER else []) + [h.ravel() for h in hessians]
                sums[end - width : end] += np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int64)), pa.array(sums)], names=["at", "value"])

    flat = np.zeros(int(ends[-1]))
    for r in rows.mapInArrow(kernel, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[r["at"]] = r["value"]
    out = []
    for ask, width, end in zip(asks, widths, ends):
        f, p = flat[end - width : end], len(ask.theta)
        squares = list(f[1 + p :].reshape(-1, p, p)) if ask.level >= OUTER else []
        out.append(Sums(float(f[0]), f[1 : 1 + p] if ask.level >= GRADIENT else None, *squares[:1], *((h + h.T) / 2 for h in squares[1:])))
    return out


def evaluate(rows: DataFrame, thetas: Sequence[np.ndarray], model: Frontier, curved: bool = False) -> list[Sums]:
    """Log-likelihood, gradient and the firms' summed outer products of scores, and Hessians, for each parameter vector; one job."""
    return evaluate_asks(rows, [Ask(np.asarray(t, float), CURVED if curved else OUTER) for t in thetas], model)


def _log_square_slopes(residuals: DataFrame, block: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of log r^2 in a block's columns, and their means: how the variance changes with its determinants."""
    zs = [F.col(block)[k] for k in range(1, size)]
    full, n = moments(residuals, [F.lit(1.0), *zs, F.log(F.greatest(F.col("r") * F.col("r"), F.lit(1e-12)))])
    slopes = np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=1e-10)[0][1:]
    return np.clip(slopes, -10, 10), full[0, 1:-1] / max(n, 1)


def _starts_from(flat: DataFrame, b: np.ndarray, model: Frontier) -> list[np.ndarray]:
    """Start values from the residuals of a regression with coefficients b, intercept first: without and with slopes of determinants.

    The residuals' firm means and deviations are split by their second and third moments. The search moves along logs of
    variances; floors keep its first point away from their edge. In logs, slopes are those of the squared residuals.
    """
    fitted = F.lit(float(b[0]))
    for k in range(len(model.x)):
        fitted = fitted + float(b[k + 1]) * F.col(f"x{k}")
    sizes = model.sizes()
    held = [c for c in sizes if c != "x"]
    residuals = flat.select("rank", (F.col("y") - fitted).alias("r"), *held)
    floor = lambda v: math.log(max(0.8 * v, 0.0025))
    part = {name: np.zeros(size) for name, size in sizes.items()}
    part["x"][:] = b[0 if model.constant() else 1 :]
    by_firm = None
    if model.effect in ("none", "fixed"):
        deviations = residuals
        found = moment_split(residuals, "r", model.s).first()
        part["zuit"][0], part["zvit"][0] = floor(found["sigma2_u"]), floor(found["sigma2_v"])
        mean_u = ROOT_TWO_OVER_PI * math.exp(0.5 * part["zuit"][0])
    else:
        firm_level = [c for c in held if c in ("zvi0", "zui0")]
        by_firm = residuals.groupBy("rank").agg(F.avg("r").alias("r"), *[F.first(c).alias(c) for c in firm_level])
        deviations = residuals.join(by_firm.select("rank", F.col("r").alias("m")), "rank").withColumn("r", F.col("r") - F.col("m"))
        transient, persistent = moment_split(deviations, "r", model.s).first(), moment_split(by_firm, "r", model.s).first()
        part["zuit"][0], part["zvit"][0] = floor(transient["sigma2_u"]), floor(transient["sigma2_v"])
        part["zvi0"][0] = floor(persistent["sigma2_v"] if model.persistent else persistent["m2"])
        mean_u = ROOT_TWO_OVER_PI * math.exp(0.5 * part["zuit"][0])
        if model.persistent:
            part["zui0"][0] = floor(persistent["sigma2_u"])
            mean_u += ROOT_TWO_OVER_PI * math.exp(0.5 * part["zui0"][0])
    if model.constant():
        part["x"][0] += model.s * mean_u
    out = [np.concatenate(list(part.values()))]
    if any(size > 1 for c, size in sizes.items() if c in held and c != "mu"):
        for c in held:
            if c != "mu" and sizes[c] > 1:
                slopes, means = _log_square_slopes(by_firm if c in ("zvi0", "zui0") else deviations, c, sizes[c])
                part[c] = np.concatenate([[part[c][0] - slopes @ means], slopes])
        out.append(np.concatenate(list(part.values())))
        # The noise's variance alone, and half the slopes.
        for share in ({"zuit": 0.0}, {"zuit": 0.5, "zvit": 0.5}):
            moved = {c: np.concatenate([v[:1], v[1:] * share.get(c, 1.0)]) if c in share else v for c, v in part.items()}
            out.append(np.concatenate(list(moved.values())))
    return out


def start_values(rows: DataFrame, model: Frontier) -> np.ndarray:
    """The likeliest of several candidates, which are compared in one job.

    Least squares, and random effects for panels with a random firm effect, each without and with slopes of the determinants.
    """
    ahead, names = int(model.constant()), [f"x{k}" for k in range(len(model.x))]
    held = [c for c in model.sizes() if c != "x"]
    flat = rows.select("rank", "y", *[F.col("x")[k + ahead].alias(x) for k, x in enumerate(names)], *held)
    if model.effect == "fixed":
        flat = within(flat.withColumnRenamed("rank", "id"), ["y", *names]).select(F.col("id").alias("rank"), *[F.col(f"{c}_w").alias(c) for c in ["y", *names]], *held)
    columns = [*([F.lit(1.0)] if ahead or model.effect == "fixed" else []), *map(F.col, names), F.col("y")]
    full, _ = moments(flat, columns)
    b = np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0]
    b = b if ahead or model.effect == "fixed" else np.append(0.0, b)
    candidates = _starts_from(flat, b, model)
    if model.effect in ("halton", "quadrature") and names and ahead:
        found = {r["term"]: r["estimate"] for r in regression(flat.withColumnRenamed("rank", "id"), "y", names, "random").collect()}
        again = np.array([found[c] for c in ("_cons", *names)])
        if np.isfinite(again).all():
            candidates += _starts_from(flat, again, model)
    if len(candidates) == 1:
        return candidates[0]
    scores = [s.loglik for s in evaluate_asks(rows, [Ask(c) for c in candidates], model)]
    return candidates[int(np.argmax(np.where(np.isfinite(scores), scores, -np.inf)))]


@dataclass
class Fit:
    model: Frontier
    theta: np.ndarray
    loglik: float
    gradient: np.ndarray
    hessian: np.ndarray
    outer: np.ndarray
    n_obs: int
    n_firms: int
    converged: bool
    steps: int = 0
    terms: list[str] = field(default_factory=list)
    #: Why the search ended; see optimise.Found.
    reason: str = ""

    @property
    def n_parameters(self) -> int:
        """Those of theta, and the firms' fixed effects."""
        return len(self.theta) + (self.n_firms if self.model.effect == "fixed" else 0)

    def vcov(self, clustered: bool = True) -> np.ndarray:
        """Inverse of minus the Hessian; clustered: the sandwich with scores summed by firm, corrected for small samples.

        A parameter that the likelihood doesn't bend with, like the log of a variance that goes to zero, gets zeros.
        """
        v = np.linalg.pinv(-self.hessian, rcond=1e-12, hermitian=True)
        if not clustered:
            return v
        n, g, k = self.n_obs, self.n_firms, self.n_parameters
        return v @ self.outer @ v * ((n - 1) / (n - k)) * (g / (g - 1))

    def boundary(self) -> list[str]:
        """Terms that the likelihood doesn't bend with, like the log of a variance that goes to zero: they have no standard error."""
        bends = np.abs(np.diag(self.hessian))
        return [t for t, b in zip(self.terms, bends) if b <= max(1e-4, 1e-12 * bends.max(initial=0))]

    def bread(self) -> np.ndarray:
        """The inverse of minus the Hessian times the number of rows."""
        return self.vcov(False) * self.n_obs

    def likelihood_ratio(self, other: Fit) -> tuple[float, int, float]:
        """(statistic, degrees of freedom, p-value) against a nested model, or one that nests this."""
        from fathomline.operators.inference import likelihood_ratio

        return likelihood_ratio((self.loglik, self.n_parameters), (other.loglik, other.n_parameters))

    def aic(self) -> float:
        return 2 * self.n_parameters - 2 * self.loglik

    def bic(self) -> float:
        return math.log(self.n_obs) * self.n_parameters - 2 * self.loglik

    def table(self, spark: SparkSession, clustered: bool = True, level: float = 0.95, normal: bool | None = None) -> DataFrame:
        """term, estimate, std_error, t, p_value, and the ends of the interval, of each parameter; n_obs - k degrees of freedom.

        normal: by the normal law, with z in place of t; the default for latent classes. A term on the boundary has none of these but its estimate.
        """
        if not 0 < level < 1:
            raise ValueError("level must be between 0 and 1")
        normal = hasattr(self.model, "classes") if normal is None else normal
        se, df, edge = np.sqrt(np.maximum(np.diag(self.vcov(clustered)), 0)), max(1, self.n_obs - self.n_parameters), set(self.boundary())
        reach = float(ndtri(np.array((1 + level) / 2))) if normal else t_quantile((1 + level) / 2, df)
        rows = []
        for name, estimate, e in zip(self.terms, map(float, self.theta), map(float, se)):
            if name in edge or not e > 0:
                rows.append((name, estimate, None, None, None, None, None))
                continue
            t = estimate / e
            p = 2 * float(np.exp(log_ndtr(np.array(-abs(t))))) if normal else 2 * t_sf(abs(t), df)
            rows.append((name, estimate, e, t, p, estimate - reach * e, estimate + reach * e))
        return spark.createDataFrame(rows, f"term string, estimate double, std_error double, {'z' if normal else 't'} double, p_value double, low double, high double")


def audited(found: Found, model: Frontier, n_obs: int, n_firms: int) -> Fit:
    """A fit from what a search found; its last sums must have been CURVED."""
    here = found.here
    return Fit(model, found.theta, here.loglik, here.gradient, here.hessian, here.outer, n_obs, n_firms, found.converged, found.steps, model.terms(), found.reason)


def maximise(rows: DataFrame, model: Frontier, theta: np.ndarray, n_obs: int, n_firms: int, options: Options | dict | None = None, method: str | None = None) -> Fit:
    """The maximum that a search finds from theta, on rows that are prepared and kept; methods: see optimise.search.

    converged: the gradient's norm is under the tolerance.
    """
    (found,) = lockstep([search(method, theta, Options.of(options), jumps=model.jumps)], lambda asks: evaluate_asks(rows, asks, model))
    return audited(found, model, n_obs, n_firms)


def counted(rows: DataFrame, model: Frontier) -> tuple[int, int]:
    """(rows, firms) of prepared rows; none is an error."""
    n_obs, n_firms = rows.agg(F.count("*"), F.lit(0) if model.effect == "none" else F.count_distinct("rank")).first()
    if not n_obs:
        raise ValueError("no complete rows")
    return n_obs, n_obs if model.effect == "none" else n_firms


def with_nodes(model: Frontier, options: Options) -> Frontier:
    return replace(model, nodes=options.em_nquad_pts) if options.em_nquad_pts and model.effect == "quadrature" else model


def checked_start(start: np.ndarray, model: Frontier) -> np.ndarray:
    theta = np.asarray(start, float)
    if len(theta) != len(model.terms()):
        raise ValueError(f"start must have {len(model.terms())} values")
    if not np.isfinite(theta).all():
        raise ValueError("start must be finite")
    return theta


def fit(panel: DataFrame, model: Frontier, start: np.ndarray | None = None, most_steps: int | None = None, tolerance: float | None = None, method: str | None = None, options: dict | Options | None = None) -> Fit:
    """Maximum of the likelihood of panel(id, time, ...), or of rows without a firm effect; see maximise.

    Rows with a null, NaN or infinite value in a column of the model are left out; none left is an error, and so is a
    determinant of a firm effect that varies within a firm. most_steps and tolerance stand for the options maxit and grad_err_tol.
    """
    check_columns(panel, model)
    options = Options.of(options, **{k: v for k, v in (("maxit", most_steps), ("grad_err_tol", tolerance)) if v is not None})
    panel = complete_cases(panel.select(*map(quoted, dict.fromkeys([*(c for c in ("id", "time") if c in panel.columns), *model.columns()]))), model.columns())
    n_rows = None
    if model.effect != "none":  # numbering the firms and dealing them out read it several times
        n_rows = panel.persist().count()
    rows = prepared(panel, model, n_rows).persist()
    try:
        n_obs, n_firms = counted(rows, model)
        check_time_invariant(panel, model.firm_columns())
        panel.unpersist()
        theta = start_values(rows, model) if start is None else checked_start(start, model)
        return maximise(rows, model, theta, n_obs, n_firms, options, method)
    finally:
        panel.unpersist()
        rows.unpersist()


def check_columns(panel: DataFrame, model: Frontier) -> None:
    """Every column that the model names must be there; panels also need id and time."""
    needed = [*model.columns(), *(() if model.effect == "none" else ("id", "time"))]
    lost = [c for c in dict.fromkeys(needed) if c not in panel.columns]
    if lost:
        raise ValueError(f"no such column: {', '.join(lost)}")


def score_rows(panel: DataFrame, theta: np.ndarray, model: Frontier) -> DataFrame:
    """id, time and the score of each complete row, a column for each term; their sums are the gradient, and by firm its outer products' factors."""
    rows = prepared(panel, model)
    kinds, terms = dict(rows.dtypes), model.terms()

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _firm_blocks(batches, model):
            found = row_scores(block, theta, model)
            yield pa.RecordBatch.from_arrays([block["id"].combine_chunks(), block["time"].combine_chunks(), *map(pa.array, np.ascontiguousarray(found.T))], names=["id", "time", *terms])

    return rows.mapInArrow(kernel, ", ".join([f"id {kinds['id']}", f"time {kinds['time']}", *(f"`{t}` double" for t in terms)]))


def firm_logliks(panel: DataFrame, theta: np.ndarray, model: Frontier) -> DataFrame:
    """id and log-likelihood of each firm, or of each row without a firm effect; those of some firms are a filter of it.

    Draws belong to a firm's place among all firms of panel, so a subset has the likelihoods that it has in the whole.
    """
    rows = prepared(panel, model)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _firm_blocks(batches, model):
            ids = block["id"].combine_chunks().take(pa.array(block["starts"]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.value(block, theta, {}))], names=["id", "loglik"])

    return rows.mapInArrow(kernel, f"id {dict(rows.dtypes)['id']}, loglik double")


#: Weights of central differences at 1, 2, ... steps, by order of accuracy.
STENCILS = {2: (1 / 2,), 4: (2 / 3, -1 / 12), 6: (3 / 4, -3 / 20, 1 / 60), 8: (4 / 5, -1 / 5, 4 / 105, -1 / 280)}


def numeric_derivatives(rows: DataFrame, theta: np.ndarray, model: Frontier, accuracy: int = 4, step: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) of prepared rows by central differences of log-likelihoods and of scores; all points are one job."""
    if accuracy not in STENCILS:
        raise ValueError("accuracy must be 2, 4, 6 or 8")
    theta = np.asarray(theta, float)
    h, weights = step * np.maximum(np.abs(theta), 1.0), STENCILS[accuracy]
    moves = [(k, j + 1, s) for k in range(len(theta)) for j in range(len(weights)) for s in (1, -1)]
    points = evaluate_asks(rows, [Ask(theta + s * j * h[k] * np.eye(len(theta))[k], GRADIENT) for k, j, s in moves], model)
    gradient, hessian = np.zeros(len(theta)), np.zeros((len(theta),) * 2)
    for (k, j, s), at in zip(moves, points):
        gradient[k] += s * weights[j - 1] * at.loglik / h[k]
        hessian[k] += s * weights[j - 1] * at.gradient / h[k]
    return gradient, (hessian + hessian.T) / 2


def model_matrix(panel: DataFrame, model: Frontier) -> DataFrame:
    """id, time, the response and a column for each term: the design of the complete rows, constants included."""
    rows = complete_cases(panel, model.columns())
    names, columns = iter(model.terms()), []
    for b, cols in model.blocks().items():
        constant = [F.lit(1.0)] if model.sizes()[b] > len(cols) else []
        columns += [c.alias(next(names)) for c in (*constant, *(F.col(quoted(c)).cast("double") for c in cols))]
    return rows.select(*[c for c in ("id", "time") if c in rows.columns], F.col(quoted(model.y)).cast("double").alias(model.y), *columns)


def efficiencies(panel: DataFrame, theta: np.ndarray, model: Frontier) -> DataFrame:
    """id, time, inefficiency E[u_it | e] and efficiency E[exp(-u_it) | e], averaged over the firm's draws by their weight."""
    rows = prepared(panel, model)
    kinds = dict(rows.dtypes)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _firm_blocks(batches, model):
            p = Paths(block, theta, model, {})
            u, eff = p.inefficiency()
            columns = [block["id"].combine_chunks(), block["time"].combine_chunks(), pa.array(u), pa.array(eff)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "time", "inefficiency", "efficiency"])

    return rows.mapInArrow(kernel, f"id {kinds['id']}, time {kinds['time']}, inefficiency double, efficiency double")


def fixed_effects(panel: DataFrame, theta: np.ndarray, model: Frontier) -> DataFrame:
    """id and effect of each firm of a panel with fixed effects, at the other parameters theta."""
    if model.effect != "fixed":
        raise ValueError("the model has no fixed effects")
    rows = prepared(panel, model)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _firm_blocks(batches, model):
            found = Paths(block, theta, model, {}).fixed[:, 0]
            yield pa.RecordBatch.from_arrays([block["id"].combine_chunks().take(pa.array(block["starts"])), pa.array(found)], names=["id", "effect"])

    return rows.mapInArrow(kernel, f"id {dict(rows.dtypes)['id']}, effect double")


def simulated_panel(spark: SparkSession, firms: int, periods: int, beta: Sequence[float], log_s2: dict[str, float], s: int = 1, seed: int = 1234) -> DataFrame:
    """A four-component panel with its truths, drawn by Spark: log_s2 has uit, vit, vi0 and, if persistent, ui0."""
    sd = {k: math.exp(0.5 * v) for k, v in log_s2.items()}
    by_firm = spark.range(1, firms + 1).select(F.col("id"), (sd["vi0"] * F.randn(seed)).alias("vi0_true"), (sd["ui0"] * F.abs(F.randn(seed + 1)) if "ui0" in sd else F.lit(0.0)).alias("ui0_true"))
    rows = by_firm.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    xs = [f"x{k}" for k in range(1, len(beta))]
    rows = rows.select("*", *[F.randn(seed + 10 + k).alias(x) for k, x in enumerate(xs)], (sd["uit"] * F.abs(F.randn(seed + 2))).alias("uit_true"), (sd["vit"] * F.randn(seed + 3)).alias("vit_true"))
    y = F.lit(float(beta[0])) + F.col("vi0_true") + F.col("vit_true") - s * (F.col("uit_true") + F.col("ui0_true"))
    for b, x in zip(beta[1:], xs):
        y = y + float(b) * F.col(x)
    return rows.withColumn("y", y)
