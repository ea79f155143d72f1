"""Optimisers that ask for likelihoods and don't compute them, so that any number of searches share one Spark job a step.

A search is a generator: it yields the parameter vectors that it wants evaluated, is sent their sums, and returns what it found.
lockstep runs many of them: the wants of all that go on are one evaluation, and those that have ended are left out of the next. Its jobs
are as many as the longest search has steps.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, fields, replace

import numpy as np

#: How much of an evaluation is wanted: the log-likelihood, also its gradient, also the outer products of scores, also Hessians.
VALUE, GRADIENT, OUTER, CURVED = range(4)


@dataclass(frozen=True)
class Ask:
    theta: np.ndarray
    level: int = VALUE
    #: Which objective, where an evaluation knows several: a class of an M-step, a replicate of a bootstrap.
    tag: int = 0


@dataclass
class Sums:
    loglik: float
    gradient: np.ndarray | None = None
    outer: np.ndarray | None = None
    #: With CURVED: the Hessian, and for a mixture that of the classes' own likelihoods at the present posteriors.
    hessian: np.ndarray | None = None
    complete: np.ndarray | None = None


@dataclass
class Found:
    theta: np.ndarray
    here: Sums
    converged: bool
    steps: int
    #: Why the search ended: "gradient", "likelihood" (an EM search), "steps", "no ascent" or "ridge" (see newton).
    reason: str


Search = Generator[list[Ask], list[Sums], Found]


@dataclass(frozen=True)
class Options:
    """Settings of searches. maxit counts steps; the searches of an EM step have limits of their own."""

    maxit: int = 200
    grad_err_tol: float = 1e-4
    tr_radius: float = 2.0
    wolfe_cons_1: float = 1e-4
    wolfe_cons_2: float = 0.9
    step_size: float = 0.1
    em_max_iter: int = 200
    em_tol: float = 1e-6
    em_nquad_pts: int | None = None
    em_seg_max_iter: int = 50
    em_class_max_iter: int = 450

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if v is not None and not v > 0 and not (f.name == "maxit" and v == 0):
                raise ValueError(f"{f.name} must be positive")

    @classmethod
    def of(cls, options: dict | Options | None, **defaults) -> Options:
        """From a dictionary of names; one that isn't an option is an error."""
        if isinstance(options, Options):
            return options
        unknown = set(options or {}) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
        return replace(cls(), **{**defaults, **(options or {})})


def lockstep(searches: Sequence[Search], evaluate: Callable[[list[Ask]], list[Sums]]) -> list[Found]:
    """What each search found; the searches that go on share one evaluation a step."""
    found: list[Found | None] = [None] * len(searches)
    asked: dict[int, list[Ask]] = {}

    def go_on(k: int, answers: list[Sums] | None) -> None:
        try:
            asked[k] = searches[k].send(answers)
        except StopIteration as end:
            found[k] = end.value
            asked.pop(k, None)

    for k in range(len(searches)):
        go_on(k, None)
    while asked:
        sums = evaluate([a for asks in asked.values() for a in asks])
        at = 0
        for k, asks in list(asked.items()):
            go_on(k, sums[at : at + len(asks)])
            at += len(asks)
    return found


def restricted_step(bend: np.ndarray, gradient: np.ndarray, radius: float = 2.0) -> np.ndarray:
    """The step that the quadratic form makes best among those no longer than radius, whether bend is positive definite or not.

    What the likelihood hardly bends with is held back, so that it doesn't shorten the steps of all others. Where it bends upwards the step
    goes to the radius, along the most upward direction if the gradient has none of it.
    """
    values, vectors = np.linalg.eigh(bend)
    along = vectors.T @ gradient
    # What changes nothing, like the log of a variance that is as good as zero, would use up the radius.
    small = 1e-13 * max(1e3, float(np.abs(values).max()))
    alive = (np.abs(along) >= 1e-8) | (np.abs(values) >= small)
    values, vectors, along = np.where(np.abs(values) < small, small, values)[alive], vectors[:, alive], along[alive]
    if not len(values):
        return np.zeros(len(gradient))
    length = lambda shift: float(np.linalg.norm(along / (values + shift)))
    least = 0.0 if values.min() > 0 else -values.min() + small
    if length(least) <= radius:
        step = along / (values + least)
        if least:
            k = int(values.argmin())
            step[k] += math.copysign(math.sqrt(max(0.0, radius**2 - step @ step)), step[k])
        return vectors @ step
    low, high = least, least + float(np.linalg.norm(gradient)) / radius
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if length(mid) > radius else (low, mid)
    return vectors @ (along / (values + high))


#: Other places worth a look from a parameter vector, as a model knows them.
Jumps = Callable[[np.ndarray], list[np.ndarray]]
#: A step that adds less than this is slow; so many of them running make a search look at jumps, and end it where there are none.
SLOW_GAIN, SLOW_STEPS, MOST_SLOW = 1e-4, 3, 40


def newton(theta: np.ndarray, options: Options, tag: int = 0, most_steps: int | None = None, tolerance: float | None = None, jumps: Jumps | None = None) -> Search:
    """Newton steps within a radius that follows how well the quadratic form foretells the likelihood.

    A step that doesn't raise it is followed by ever shorter ones, each with the direction that is best at its length, in one evaluation; by
    the Hessian, and by the curves that are definite by their form: the classes' own likelihoods' and the scores' outer products.
    On a bent ridge, along which a variance goes to zero, quadratic steps stay short: when they have become slow, a few steps are made from the
    likeliest jump, and the search goes on there if that is likelier than here. A search that stays slow ends as "ridge".
    """
    slow = 0
    most_steps, tolerance = options.maxit if most_steps is None else most_steps, tolerance or options.grad_err_tol
    radius = options.tr_radius
    (here,) = yield [Ask(theta, CURVED, tag)]
    for steps in range(most_steps + 1):
        if np.linalg.norm(here.gradient) < tolerance:
            return Found(theta, here, True, steps, "gradient")
        if steps == most_steps or not (np.isfinite(here.gradient).all() and np.isfinite(here.hessian).all()):
            break
        step = restricted_step(-here.hessian, here.gradient, radius)
        (there,) = yield [Ask(theta + step, CURVED, tag)]
        if there.loglik > here.loglik and np.isfinite(there.gradient).all():
            foretold = here.gradient @ step + 0.5 * step @ here.hessian @ step
            share, size = (there.loglik - here.loglik) / max(foretold, 1e-300), float(np.linalg.norm(step))
            radius = min(2 * radius, 16 * options.tr_radius) if share > 0.75 and size > 0.9 * radius else max(size / 2, 1e-8) if share < 0.25 else radius
        else:
            size = min(radius, float(np.linalg.norm(step)))
            bends = [-here.hessian, here.outer + 1e-6 * np.eye(len(theta)), *([] if here.complete is None else [-here.complete])]
            shorter = [restricted_step(b, here.gradient, size * 4.0**-k) for b in bends if np.isfinite(b).all() for k in range(1, 11)]
            tried = [t.loglik for t in (yield [Ask(theta + x, VALUE, tag) for x in shorter])]
            best = int(np.argmax(np.where(np.isfinite(tried), tried, -np.inf)))
            if not tried[best] > here.loglik:
                return Found(theta, here, False, steps, "no ascent")
            step = shorter[best]
            radius = max(float(np.linalg.norm(step)), 1e-8)
            (there,) = yield [Ask(theta + step, CURVED, tag)]
        slow = slow + 1 if there.loglik - here.loglik < SLOW_GAIN else 0
        theta, here = theta + step, there
        if slow in (SLOW_STEPS, 4 * SLOW_STEPS) and jumps and (places := jumps(theta)):
            tried = [t.loglik for t in (yield [Ask(x, VALUE, tag) for x in places])]
            best = int(np.argmax(np.where(np.isfinite(tried), tried, -np.inf)))
            if np.isfinite(tried[best]):
                near = yield from newton(places[best], options, tag, 8, tolerance)
                if near.here.loglik >= here.loglik - 1e-9:
                    theta, here, radius, slow = near.theta, near.here, options.tr_radius, 0
        if slow >= MOST_SLOW:
            return Found(theta, here, bool(np.linalg.norm(here.gradient) < tolerance), steps + 1, "ridge")
    return Found(theta, here, False, steps, "steps")


#: A point of a line: its place, minus the log-likelihood, the slope, and the sums there.
_Point = tuple[float, float, float, Sums]


def _on_line(theta: np.ndarray, direction: np.ndarray, at: float, tag: int) -> Generator[list[Ask], list[Sums], _Point]:
    (there,) = yield [Ask(theta + at * direction, GRADIENT, tag)]
    if not (np.isfinite(there.loglik) and np.isfinite(there.gradient).all()):
        return at, math.inf, math.inf, there
    return at, -there.loglik, float(-there.gradient @ direction), there


def _cubic(a: _Point, b: _Point) -> float:
    """The least point of the cubic through two points and their slopes, kept a tenth of the way from either end."""
    low, high = min(a[0], b[0]), max(a[0], b[0])
    at = math.nan
    if math.isfinite(a[1]) and math.isfinite(b[1]):
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        square = d1 * d1 - a[2] * b[2]
        if square >= 0:
            d2 = math.copysign(math.sqrt(square), b[0] - a[0])
            below = b[2] - a[2] + 2 * d2
            at = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / below if below else math.nan
    edge = 0.1 * (high - low)
    return min(max(at, low + edge), high - edge) if math.isfinite(at) else (low + high) / 2


def wolfe(theta: np.ndarray, here: Sums, direction: np.ndarray, first: float, options: Options, tag: int = 0) -> Generator[list[Ask], list[Sums], _Point | None]:
    """A point along direction that meets the strong Wolfe conditions, or None: steps are doubled until they bracket one, then zoomed."""
    c1, c2 = options.wolfe_cons_1, options.wolfe_cons_2
    start: _Point = (0.0, -here.loglik, float(-here.gradient @ direction), here)
    enough = lambda p: p[1] <= start[1] + c1 * p[0] * start[2]
    before, at = start, first
    low = high = None
    for k in range(20):
        now = yield from _on_line(theta, direction, at, tag)
        if not enough(now) or k and now[1] >= before[1]:
            low, high = before, now
            break
        if abs(now[2]) <= -c2 * start[2]:
            return now
        if now[2] >= 0:
            low, high = now, before
            break
        before, at = now, 2 * at
    if low is None:
        return before if before[0] else None
    for _ in range(30):
        now = yield from _on_line(theta, direction, _cubic(low, high), tag)
        if not enough(now) or now[1] >= low[1]:
            high = now
        else:
            if abs(now[2]) <= -c2 * start[2]:
                return now
            if now[2] * (high[0] - low[0]) >= 0:
                high = low
            low = now
        if abs(high[0] - low[0]) * np.linalg.norm(direction) < 1e-14:
            break
    return low if low[0] else None


def bfgs(theta: np.ndarray, options: Options, memory: int | None = None, tag: int = 0, tolerance: float | None = None, curved: bool = True) -> Search:
    """Quasi-Newton steps on gradients alone, along lines with the strong Wolfe conditions.

    memory: None keeps the whole inverse Hessian (BFGS), a number that many pairs of steps (L-BFGS, by the two-loop recursion). A task sends as
    many numbers as there are parameters, not their square; curved: but for the Hessian at the end.
    """
    tolerance = tolerance or options.grad_err_tol
    (here,) = yield [Ask(theta, GRADIENT, tag)]
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory or 1)
    inverse, converged, reason, steps = None, False, "steps", 0
    for steps in range(options.maxit + 1):
        g = -here.gradient
        if not np.isfinite(g).all():
            break
        if np.linalg.norm(g) < tolerance:
            converged, reason = True, "gradient"
            break
        if steps == options.maxit:
            break
        direction = -(_two_loops(pairs, g) if memory else g if inverse is None else inverse @ g)
        if not g @ direction < 0:
            pairs.clear()
            inverse, direction = None, -g
        fresh = not pairs
        point = yield from wolfe(theta, here, direction, options.step_size / max(1.0, float(np.linalg.norm(g))) if fresh else 1.0, options, tag)
        if point is None and not fresh:  # steepest ascent
            pairs.clear()
            inverse, direction = None, -g
            point = yield from wolfe(theta, here, direction, options.step_size / max(1.0, float(np.linalg.norm(g))), options, tag)
        if point is None:
            reason = "no ascent"
            break
        s, y = point[0] * direction, -point[3].gradient - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs.append((s, y))
            if not memory:
                scale = 1 / (s @ y)
                inverse = np.eye(len(theta)) * (s @ y) / (y @ y) if inverse is None else inverse
                left = np.eye(len(theta)) - scale * np.outer(s, y)
                inverse = left @ inverse @ left.T + scale * np.outer(s, s)
        theta, here = theta + s, point[3]
    if curved:
        (here,) = yield [Ask(theta, CURVED, tag)]
    return Found(theta, here, converged, steps, reason)


def _two_loops(pairs: Sequence[tuple[np.ndarray, np.ndarray]], g: np.ndarray) -> np.ndarray:
    """The inverse Hessian that the pairs of steps imply, times g."""
    q, shares = g.copy(), []
    for s, y in reversed(pairs):
        shares.append((s @ q) / (s @ y))
        q -= shares[-1] * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), share in zip(pairs, reversed(shares)):
        q += (share - (y @ q) / (s @ y)) * s
    return q


def neighbours(topology: str, n: int, rng: np.random.Generator) -> np.ndarray:
    """(n, n): which particles each one hears of, itself included; "graph" and "dynamic" draw three for each."""
    near, every = np.eye(n, dtype=bool), np.arange(n)
    if topology == "global":
        near[:] = True
    elif topology == "ring":
        near[every, (every + 1) % n] = near[every, (every - 1) % n] = True
    elif topology == "von_neumann":
        columns = max(k for k in range(1, math.isqrt(n) + 1) if n % k == 0)
        row, column, rows = every // columns, every % columns, n // columns
        for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            near[every, (row + dr) % rows * columns + (column + dc) % columns] = True
    elif topology in ("graph", "dynamic"):
        near[rng.integers(n, size=(3, n)), every] = True
    else:
        raise ValueError("topology must be global, ring, von_neumann, graph or dynamic")
    return near


def swarm(theta: np.ndarray, width: float, iterations: int, particles: int = 40, topology: str = "von_neumann", seed: int = 1, tag: int = 0) -> Search:
    """Particles within width of theta, which is one of them; an iteration is one evaluation of all.

    Velocities are held by the constriction factor of 2.05 + 2.05 and a fifth of the range, and turned round at the walls. A particle
    whose likelihood isn't finite five times running begins anew. The search ends when 50 iterations bring nothing.
    """
    rng, p = np.random.default_rng([seed, tag]), len(theta)
    low, high = theta - width, theta + width
    phi = 4.1
    squeeze, most = 2 / abs(2 - phi - math.sqrt(phi * phi - 4 * phi)), 0.2 * (high - low)
    place = rng.uniform(low, high, (particles, p))
    place[0] = theta
    speed = rng.uniform(-most, most, (particles, p))
    best, value = place.copy(), np.full(particles, -np.inf)
    bad, idle, near = np.zeros(particles, int), 0, neighbours(topology, particles, rng)
    for steps in range(iterations):
        got = np.array([s.loglik for s in (yield [Ask(x, VALUE, tag) for x in place])])
        whole = np.isfinite(got)
        top = value.max()
        better = whole & (got > value)
        best[better], value[better] = place[better], got[better]
        idle = 0 if value.max() > top + 1e-10 * (1 + abs(top) if math.isfinite(top) else 0) else idle + 1
        if idle >= 50:
            break
        if idle and topology == "dynamic":
            near = neighbours(topology, particles, rng)
        bad = np.where(whole, 0, bad + 1)
        leader = best[np.where(near, value[None, :], -np.inf).argmax(axis=1)]
        pull = 2.05 * rng.random((particles, p)) * (best - place) + 2.05 * rng.random((particles, p)) * (leader - place)
        speed = np.clip(squeeze * (speed + pull), -most, most)
        place = place + speed
        out = (place < low) | (place > high)
        speed[out] *= -1
        place = np.where(place < low, np.minimum(2 * low - place, high), np.where(place > high, np.maximum(2 * high - place, low), place))
        again = bad >= 5
        place[again], speed[again], bad[again] = rng.uniform(low, high, (int(again.sum()), p)), 0, 0
    k = int(value.argmax())
    (here,) = yield [Ask(best[k], GRADIENT, tag)]
    return Found(best[k], here, False, steps + 1, "steps")


METHODS = ("tr", "bfgs", "lbfgs", "bfgs_tr", "lbfgs_tr", "pso_tr", "pso_bfgs_tr")
#: Most parameters for which Newton steps are the default; beyond, squares of them would be sent by every task.
NEWTON_PARAMETERS = 50


def search(method: str | None, theta: np.ndarray, options: Options, tag: int = 0, seed: int = 1, topology: str = "von_neumann", jumps: Jumps | None = None) -> Search:
    """The search that a method names; hybrid_ before the name is allowed. None: tr, and lbfgs beyond NEWTON_PARAMETERS.

    A swarm looks within 2 of theta first and, if the gradient isn't near zero after that, within 5.
    """
    name = (method or ("tr" if len(theta) <= NEWTON_PARAMETERS else "lbfgs")).removeprefix("hybrid_")
    if name not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    memory = 10 if "lbfgs" in name else None

    def run() -> Search:
        at, steps = np.asarray(theta, float), 0
        if name.startswith("pso"):
            found = yield from swarm(at, 2.0, 200, topology=topology, seed=seed, tag=tag)
            at, steps = found.theta, found.steps
            if not np.linalg.norm(found.here.gradient) < options.grad_err_tol:
                polished = yield from newton(at, options, tag, jumps=jumps)
                if polished.converged:
                    return replace(polished, steps=steps + polished.steps)
                wide = yield from swarm(at, 5.0, 300, topology=topology, seed=seed + 1, tag=tag)
                at, steps = wide.theta, steps + wide.steps
        if "bfgs" in name:
            last = not name.endswith("_tr")
            found = yield from bfgs(at, options, memory, tag, None if last else 1e-2, curved=last)
            if last:
                return replace(found, steps=steps + found.steps)
            at, steps = found.theta, steps + found.steps
        found = yield from newton(at, options, tag, jumps=jumps)
        return replace(found, steps=steps + found.steps)

    return run()
