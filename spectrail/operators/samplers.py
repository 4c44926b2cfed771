"""Samplers: ensemble MCMC, ensemble slice sampling, static and dynamic nested sampling, likelihood-free regression.

A chain is sequential, so that one task runs one (object, chain) group from start to
end and thousands of groups run side by side; there is never a Spark job per step.
The posterior is a function of a batch of parameter rows. Seeds come from the group's
keys, so that partitioning changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LnProb = Callable[[np.ndarray], np.ndarray]
LOG_LARGE = -1e300


def seed_of(*keys: object) -> np.random.Generator:
    digest = hashlib.blake2b("|".join(map(repr, keys)).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


def _clean(f: LnProb) -> LnProb:
    def g(theta: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.nan_to_num(np.asarray(f(theta), dtype=float), nan=-np.inf, posinf=np.inf, neginf=-np.inf)

    return g


def stretch(rng: np.random.Generator, x: np.ndarray, other: np.ndarray, scale: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Proposals along lines through walkers of the other half (Goodman & Weare 2010), with their log factors."""
    z = ((scale - 1) * rng.random(len(x)) + 1) ** 2 / scale
    partner = other[rng.integers(len(other), size=len(x))]
    return partner + z[:, None] * (x - partner), (x.shape[1] - 1) * np.log(z)


def differential(rng: np.random.Generator, x: np.ndarray, other: np.ndarray, jitter: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Steps along differences of two walkers of the other half."""
    n, d = x.shape
    first = rng.integers(len(other), size=n)
    second = (first + rng.integers(1, len(other), size=n)) % len(other)
    gamma = 2.38 / math.sqrt(2 * d) * (1 + jitter * rng.standard_normal((n, 1)))
    return x + gamma * (other[first] - other[second]), np.zeros(n)


def snooker(rng: np.random.Generator, x: np.ndarray, other: np.ndarray, gamma: float = 1.7) -> tuple[np.ndarray, np.ndarray]:
    """Steps along the line to one walker by the projected difference of two others (ter Braak & Vrugt 2008)."""
    n, d = x.shape
    z, a, b = (other[np.argsort(rng.random((n, len(other))), axis=1)[:, :3].T[i]] for i in range(3))
    line = x - z
    norm = np.linalg.norm(line, axis=1, keepdims=True)
    unit = line / np.where(norm > 0, norm, 1)
    new = x + gamma * unit * ((unit * (a - b)).sum(axis=1, keepdims=True))
    far = np.linalg.norm(new - z, axis=1)
    with np.errstate(divide="ignore"):
        return new, (d - 1) * (np.log(far) - np.log(norm[:, 0]))


MOVES = {"stretch": stretch, "de": differential, "snooker": snooker}


@dataclass(frozen=True)
class EnsembleMCMC:
    """Affine-invariant ensemble sampling with a mixture of moves."""

    walkers: int = 32
    steps: int = 1000
    burn_in: int = 0
    moves: tuple[tuple[str, float], ...] = (("stretch", 1.0),)

    def run(self, f: LnProb, start: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chain [step, walker, parameter], log-probabilities and acceptances [step, walker], after burn-in."""
        f = _clean(f)
        names, weights = zip(*self.moves, strict=True)
        weights = np.array(weights) / sum(weights)
        x, lp = start.copy(), f(start)
        half = self.walkers // 2
        chain, probs, taken = [], [], []
        for step in range(self.steps):
            move = MOVES[names[rng.choice(len(names), p=weights)]]
            accepted = np.zeros(self.walkers, dtype=bool)
            order = rng.permutation(self.walkers)
            for mine, theirs in ((order[:half], order[half:]), (order[half:], order[:half])):
                new, factor = move(rng, x[mine], x[theirs])
                new_lp = f(new)
                with np.errstate(invalid="ignore"):
                    yes = np.log(rng.random(len(mine))) < factor + new_lp - lp[mine]
                x[mine[yes]], lp[mine[yes]], accepted[mine[yes]] = new[yes], new_lp[yes], True
            if step >= self.burn_in:
                chain.append(x.copy())
                probs.append(lp.copy())
                taken.append(accepted)
        return np.array(chain), np.array(probs), np.array(taken)


@dataclass(frozen=True)
class EnsembleSlice:
    """Ensemble slice sampling along differences of walkers (Karamanis & Beutler 2021), all walkers of a half at once."""

    walkers: int = 32
    steps: int = 500
    burn_in: int = 0
    mu: float = 1.0
    most_expansions: int = 100

    def run(self, f: LnProb, start: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = _clean(f)
        x, lp, mu = start.copy(), f(start), self.mu
        half = self.walkers // 2
        chain, probs = [], []
        for step in range(self.steps):
            order = rng.permutation(self.walkers)
            grown = shrunk = 0
            for mine, theirs in ((order[:half], order[half:]), (order[half:], order[:half])):
                n = len(mine)
                first = rng.integers(len(theirs), size=n)
                second = (first + rng.integers(1, len(theirs), size=n)) % len(theirs)
                line = 2 * mu * (x[theirs[first]] - x[theirs[second]])
                level = lp[mine] + np.log(rng.random(n))
                left = -rng.random(n)
                right = left + 1
                for end, sign in ((left, -1.0), (right, 1.0)):
                    live = np.arange(n)
                    for _ in range(self.most_expansions):
                        live = live[f(x[mine[live]] + end[live, None] * line[live]) > level[live]]
                        if not len(live):
                            break
                        end[live] += sign
                        grown += len(live)
                live = np.arange(n)
                while len(live):
                    at = left[live] + (right[live] - left[live]) * rng.random(len(live))
                    new = x[mine[live]] + at[:, None] * line[live]
                    new_lp = f(new)
                    good = new_lp > level[live]
                    x[mine[live[good]]], lp[mine[live[good]]] = new[good], new_lp[good]
                    bad, at = live[~good], at[~good]
                    left[bad] = np.where(at < 0, at, left[bad])
                    right[bad] = np.where(at >= 0, at, right[bad])
                    shrunk += len(bad)
                    live = bad[(right[bad] - left[bad]) > 1e-12]
            if step < self.burn_in:
                mu *= 2 * max(grown, 1) / (max(grown, 1) + max(shrunk, 1))
            if step >= self.burn_in:
                chain.append(x.copy())
                probs.append(lp.copy())
        return np.array(chain), np.array(probs), np.ones((len(chain), self.walkers), dtype=bool)


def find_mode(f: LnProb, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Nelder and Mead's simplex; seeds walkers near the mode."""
    f = _clean(f)
    d = len(start)
    simplex = np.vstack([start, start + np.diag(np.where(start != 0, 0.05 * start, 0.00025))])
    value = -f(simplex)
    for _ in range(steps):
        order = np.argsort(value)
        simplex, value = simplex[order], value[order]
        if np.ptp(value[np.isfinite(value)]) < 1e-10 if np.isfinite(value).any() else True:
            break
        centre, worst = simplex[:-1].mean(axis=0), simplex[-1]
        tries = np.array([2 * centre - worst, 3 * centre - 2 * worst, 1.5 * centre - 0.5 * worst, 0.5 * centre + 0.5 * worst])
        got = -f(tries)
        if got[0] < value[0]:
            k = 1 if got[1] < got[0] else 0
        elif got[0] < value[-2]:
            k = 0
        else:
            k = 2 if got[0] < value[-1] and got[2] <= got[0] else 3
        if k < 3 or got[3] < value[-1]:
            simplex[-1], value[-1] = tries[k], got[k]
        else:
            simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
            value[1:] = -f(simplex[1:])
    return simplex[np.argmin(value)]


def start_walkers(f: LnProb, rng: np.random.Generator, walkers: int, guess: np.ndarray | None, prior_draws: np.ndarray | None, optimise: bool = True, spread: float = 1e-3) -> np.ndarray:
    """Walkers in a ball around the mode found from a guess, or prior draws without a guess."""
    if guess is None:
        if prior_draws is None:
            raise ValueError("walkers start from a guess or from prior draws")
        return prior_draws[:walkers].copy()
    centre = find_mode(f, np.asarray(guess, dtype=float)) if optimise else np.asarray(guess, dtype=float)
    return centre * (1 + spread * rng.standard_normal((walkers, len(centre)))) + 1e-8 * rng.standard_normal((walkers, len(centre)))


class Ellipsoids:
    """Ellipsoids about points, enlarged; where points lie in clumps there is one about each clump.

    A clump is split in two as long as that makes its volume much smaller.
    """

    def __init__(self, points: np.ndarray, enlarge: float, many: bool):
        self.enlarge, self.many = enlarge, many
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        self._about(points)
        volumes = np.array([v for _, _, v in self.parts])
        self.chance = np.exp(volumes - volumes.max())
        self.chance /= self.chance.sum()

    def _bound(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Centre, factor of the shape matrix and log volume (but for the unit ball's)."""
        centre, d = points.mean(axis=0), points.shape[1]
        factor = np.linalg.cholesky(np.atleast_2d(np.cov(points.T)) + 1e-18 * np.eye(d))
        reach = np.linalg.norm(np.linalg.solve(factor, (points - centre).T), axis=0).max()
        factor = factor * max(reach, 1e-12) * self.enlarge ** (1 / d)
        return centre, factor, float(np.log(np.diag(factor)).sum())

    def _about(self, points: np.ndarray) -> None:
        whole = self._bound(points)
        least = 2 * (points.shape[1] + 1)
        if self.many and len(points) >= 2 * least:
            side = self._two_clumps(points, whole)
            if min(side.sum(), (~side).sum()) >= least:
                halves = [self._bound(points[side]), self._bound(points[~side])]
                if np.logaddexp(halves[0][2], halves[1][2]) < whole[2] + math.log(0.5):
                    self._about(points[side])
                    self._about(points[~side])
                    return
        self.parts.append(whole)

    @staticmethod
    def _two_clumps(points: np.ndarray, whole: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
        """Two means in the ellipsoid's own metric, from the ends of its longest spread."""
        z = np.linalg.solve(whole[1], (points - whole[0]).T).T
        axis = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[2][0]
        side = z @ axis > np.median(z @ axis)
        for _ in range(20):
            if side.all() or not side.any():
                break
            a, b = z[side].mean(axis=0), z[~side].mean(axis=0)
            new = ((z - a) ** 2).sum(axis=1) < ((z - b) ** 2).sum(axis=1)
            if (new == side).all():
                break
            side = new
        return side

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Points even over the union: what lies in several ellipsoids is kept once in as many times."""
        d = len(self.parts[0][0])
        z = rng.standard_normal((n, d))
        z *= (rng.random((n, 1)) ** (1 / d)) / np.linalg.norm(z, axis=1, keepdims=True)
        which = rng.choice(len(self.parts), size=n, p=self.chance)
        points = np.empty((n, d))
        for i, (centre, factor, _) in enumerate(self.parts):
            points[which == i] = centre + z[which == i] @ factor.T
        if len(self.parts) == 1:
            return points
        inside = sum((np.linalg.norm(np.linalg.solve(factor, (points - centre).T), axis=0) <= 1 + 1e-9).astype(int) for centre, factor, _ in self.parts)
        return points[rng.random(n) * np.maximum(inside, 1) < 1]


@dataclass
class Strand:
    """Points of a nested run: where they are, their likelihood, and the likelihood above which they were drawn."""

    u: np.ndarray
    theta: np.ndarray
    logl: np.ndarray
    birth: np.ndarray


def merge_strands(strands: Sequence[Strand]) -> pd.DataFrame:
    """Strands as one run: iter, theta, logl, logvol, logwt and the running logz.

    A point's volume shrinks by the number of points that were alive with it, those drawn below it and not dead yet.
    """
    logl, birth = (np.concatenate([getattr(x, n) for x in strands]) for n in ("logl", "birth"))
    theta = np.concatenate([x.theta for x in strands])
    order = np.argsort(logl, kind="stable")
    logl, theta, born = logl[order], theta[order], np.sort(birth)
    alive = np.searchsorted(born, logl, side="left") - np.arange(len(logl))
    logvol = np.cumsum(np.log1p(-1 / (np.maximum(alive, 1) + 1)))
    before = np.r_[0.0, logvol[:-1]]
    logwt = before + np.log1p(-np.exp(logvol - before)) + logl
    return pd.DataFrame({"iter": np.arange(len(logl)), "theta": list(theta), "logl": logl, "logvol": logvol, "logwt": logwt, "logz": np.logaddexp.accumulate(logwt)})


@dataclass(frozen=True)
class NestedSampler:
    """Static nested sampling: new live points come from enlarged ellipsoids about the live ones, inside the cube's bounds.

    `bound` is "multi", ellipsoids about each clump, or "single".
    """

    live: int = 200
    dlogz: float = 0.1
    enlarge: float = 1.25
    most_iterations: int = 100_000
    batch: int = 64
    bound: str = "multi"

    def run(self, f: LnProb, transform: Callable[[np.ndarray], np.ndarray], dimensions: int, rng: np.random.Generator) -> pd.DataFrame:
        """Dead then live points: iter, theta, logl, logvol, logwt and the running logz."""
        return merge_strands([self._strand(_clean(f), transform, rng, rng.random((self.live, dimensions)))])

    def _strand(self, f: LnProb, transform: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator, u: np.ndarray, floor: float = -np.inf, ceiling: float = np.inf) -> Strand:
        """Points from `u`, which lie above `floor`, up to `ceiling` or until what is left adds less than dlogz."""
        u, theta = u.copy(), transform(u)
        logl = np.maximum(f(theta), LOG_LARGE)
        birth = np.full(len(u), floor)
        logz, shrink = -np.inf, -1.0 / len(u)
        width = math.log1p(-math.exp(shrink))
        dead: list[tuple[np.ndarray, np.ndarray, float, float]] = []
        spare: list[tuple[np.ndarray, np.ndarray, float]] = []
        for i in range(self.most_iterations):
            worst = int(np.argmin(logl))
            logz = np.logaddexp(logz, i * shrink + width + logl[worst])
            if logl[worst] >= ceiling or (ceiling == np.inf and np.logaddexp(logz, logl.max() + (i + 1) * shrink) - logz < self.dlogz):
                break
            dead.append((u[worst].copy(), theta[worst].copy(), logl[worst], birth[worst]))
            floor = logl[worst]
            spare = [x for x in spare if x[2] > floor]
            while not spare:
                spare = self._above(f, transform, rng, u, floor)
            birth[worst] = floor
            u[worst], theta[worst], logl[worst] = spare.pop()
        old = [np.array([x[k] for x in dead]) for k in range(4)]
        join = lambda a, b: np.concatenate([a, b]) if len(a) else b
        return Strand(join(old[0], u), join(old[1], theta), join(old[2], logl), join(old[3], birth))

    def _above(self, f: LnProb, transform: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator, about: np.ndarray, floor: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Some points above `floor`, drawn about points that are."""
        trial = Ellipsoids(about, self.enlarge, self.bound == "multi").draw(rng, self.batch)
        trial = trial[((trial > 0) & (trial < 1)).all(axis=1)]
        if not len(trial):
            return []
        where = transform(trial)
        return [(a, b, float(c)) for a, b, c in zip(trial, where, f(where), strict=True) if c > floor]


@dataclass(frozen=True)
class DynamicNestedSampler(NestedSampler):
    """Nested sampling with more live points where the posterior, or the evidence, needs them.

    After a static run strands of `more` live points are added, `strands` times, each over the likelihoods at which
    points are at least `edge` as important as the most important one; `posterior` is the posterior's part of importance.
    """

    strands: int = 4
    more: int = 100
    posterior: float = 0.8
    edge: float = 0.8

    def run(self, f: LnProb, transform: Callable[[np.ndarray], np.ndarray], dimensions: int, rng: np.random.Generator) -> pd.DataFrame:
        f = _clean(f)
        found = [self._strand(f, transform, rng, rng.random((self.live, dimensions)))]
        for _ in range(self.strands):
            run = merge_strands(found)
            mass = np.exp(run["logwt"].to_numpy() - run["logz"].iloc[-1])
            left = np.clip(1 - np.cumsum(mass), 0, None)
            importance = self.posterior * mass / mass.sum() + (1 - self.posterior) * left / max(left.sum(), 1e-300)
            wanted = np.flatnonzero(importance >= self.edge * importance.max())
            logl = run["logl"].to_numpy()
            low = logl[wanted[0] - 1] if wanted[0] else -np.inf
            high = logl[wanted[-1] + 1] if wanted[-1] + 1 < len(logl) else np.inf
            start = self._start(f, transform, rng, found, low, dimensions)
            found.append(self._strand(f, transform, rng, start, low, high))
        return merge_strands(found)

    def _start(self, f: LnProb, transform: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator, found: Sequence[Strand], low: float, dimensions: int) -> np.ndarray:
        if low == -np.inf:
            return rng.random((self.more, dimensions))
        # All points known above the level show where it is; new ones are drawn about them.
        known = np.concatenate([x.u[x.logl > low] for x in found])
        new: list[np.ndarray] = []
        while len(new) < self.more:
            new += [a for a, _, _ in self._above(f, transform, rng, known, low)]
        return np.array(new[: self.more])


@dataclass
class GaussianPosterior:
    """A regression of theta on summaries of x with Gaussian residuals, truncated at the prior's bounds."""

    weights: np.ndarray
    covariance: np.ndarray
    basis: np.ndarray
    centre: np.ndarray

    def mean(self, x: np.ndarray) -> np.ndarray:
        s = (np.atleast_2d(x) - self.centre) @ self.basis
        return np.column_stack([np.ones(len(s)), s]) @ self.weights


def moments(theta: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of rows of theta and x side by side: they add up over batches."""
    z = np.column_stack([theta, x])
    return len(z), z.sum(axis=0), z.T @ z


def fit_posterior_of(n: int, total: np.ndarray, products: np.ndarray, parameters: int, features: int = 20) -> GaussianPosterior:
    """Principal components of x as embedding, then least squares with a Gaussian residual, all from moments."""
    centre = total / n
    cov = products - n * np.outer(centre, centre)
    inner, cross, outer = cov[:parameters, :parameters], cov[parameters:, :parameters], cov[parameters:, parameters:]
    size, axes = np.linalg.eigh(outer)
    keep = min(features, int((size > 1e-12 * max(size[-1], 1e-300)).sum())) or 1
    basis = axes[:, ::-1][:, :keep]
    slopes = np.linalg.solve(basis.T @ outer @ basis, basis.T @ cross)
    rest = inner - (basis.T @ cross).T @ slopes
    return GaussianPosterior(np.vstack([centre[:parameters], slopes]), rest / max(1, n - keep - 1), basis, centre[parameters:])


def fit_posterior(theta: np.ndarray, x: np.ndarray, features: int = 20) -> GaussianPosterior:
    centre, scale = theta.mean(axis=0), x.mean(axis=0)
    fitted = fit_posterior_of(*moments(theta - centre, x - scale), theta.shape[1], features)
    weights = fitted.weights.copy()
    weights[0] += centre
    return GaussianPosterior(weights, fitted.covariance, fitted.basis, fitted.centre + scale)


@dataclass(frozen=True)
class SequentialPosterior:
    """Simulation-based inference in rounds; every round proposes from the posterior of the round before.

    Later rounds are regressed on draws from their proposal, so that their Gaussian is the posterior times the
    proposal; dividing the proposal out again gives the posterior under a flat prior. `embed` takes rows of x to rows
    of what stands for them (principal components of that are regressed on). With `nearest` below one the posterior
    isn't a Gaussian: that part of the last round's simulations, the nearest to the observation, is moved along the
    regression to it and weighted by nearness.
    """

    simulations: int = 1000
    rounds: int = 1
    draws: int = 1000
    features: int = 20
    embed: Callable[[np.ndarray], np.ndarray] | None = None
    nearest: float = 1.0

    def embedded(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(x)
        return x if self.embed is None else np.atleast_2d(self.embed(x))

    def run(self, sample_prior: Callable[[int, np.random.Generator], np.ndarray], in_support: Callable[[np.ndarray], np.ndarray], simulate: Callable[[np.ndarray, np.random.Generator], np.ndarray], observed: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """All rounds of one object in one task."""
        theta = sample_prior(self.simulations, rng)
        now = None
        for round_ in range(self.rounds):
            if round_:
                theta = draw_gaussian(now, in_support, self.simulations, rng)
            now = self.next_posterior(fit_posterior(theta, self.embedded(simulate(theta, rng)), self.features), observed, now)
        return draw_gaussian(now, in_support, self.draws, rng)

    def next_posterior(self, fitted: GaussianPosterior, observed: np.ndarray, now: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        new = fitted.mean(self.embedded(observed))[0], np.atleast_2d(fitted.covariance)
        return new if now is None else _divide(new, now)


def moved(posterior: GaussianPosterior, theta: np.ndarray, x: np.ndarray, observed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simulated parameters moved along the regression to the observation, and their distances from it in the regression's terms."""
    shift = posterior.mean(observed) - posterior.mean(x)
    scale = np.sqrt(np.maximum(np.diag(np.atleast_2d(posterior.covariance)), 1e-300))
    return theta + shift, np.sqrt(((shift / scale) ** 2).sum(axis=1))


def _divide(top: tuple[np.ndarray, np.ndarray], bottom: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One Gaussian over another; the first alone where the quotient is none."""
    p, q = np.linalg.inv(top[1]), np.linalg.inv(bottom[1])
    if np.linalg.eigvalsh(p - q).min() <= 0:
        return top
    cov = np.linalg.inv(p - q)
    return cov @ (p @ top[0] - q @ bottom[0]), cov


def draw_gaussian(gaussian: tuple[np.ndarray, np.ndarray], in_support: Callable[[np.ndarray], np.ndarray], n: int, rng: np.random.Generator) -> np.ndarray:
    kept, have = [], 0
    for _ in range(200):
        t = rng.multivariate_normal(*gaussian, size=n)
        t = t[in_support(t)]
        kept.append(t)
        have += len(t)
        if have >= n:
            break
    return np.concatenate(kept)[:n]


CHAIN_SCHEMA = "walker int, step int, theta array<double>, lnprob double, accepted boolean"
NESTED_SCHEMA = "iter int, theta array<double>, logl double, logvol double, logwt double, logz double"


@dataclass(frozen=True)
class Problem:
    """What a group's rows become: a log-posterior, or likelihood and transform, a start and a dimension."""

    lnprob: LnProb
    dimensions: int
    guess: np.ndarray | None = None
    prior_draws: Callable[[int, np.random.Generator], np.ndarray] | None = None
    lnlike: LnProb | None = None
    transform: Callable[[np.ndarray], np.ndarray] | None = None
    extra: dict = field(default_factory=dict)


def run_chains(df: DataFrame, keys: Sequence[str], problem: Callable[[pd.DataFrame], Problem], sampler: EnsembleMCMC | EnsembleSlice, chains: int = 1, seed: int = 0) -> DataFrame:
    """Chains of every group of df; each (group, chain) is one task's work."""
    from pyspark.sql import functions as F

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = seed_of(seed, *[pdf[k].iloc[0] for k in keys], int(pdf["chain"].iloc[0]))
        p = problem(pdf)
        draws = p.prior_draws(sampler.walkers, rng) if p.prior_draws else None
        chain, lnprob, accepted = sampler.run(p.lnprob, start_walkers(p.lnprob, rng, sampler.walkers, p.guess, draws), rng)
        s, w = chain.shape[:2]
        out = pd.DataFrame({"walker": np.tile(np.arange(w), s), "step": np.repeat(np.arange(s), w) + sampler.burn_in, "theta": list(chain.reshape(s * w, -1)), "lnprob": lnprob.ravel(), "accepted": accepted.ravel()})
        for k in [*keys, "chain"]:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "chain", "walker", "step", "theta", "lnprob", "accepted"]]

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    many = df.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return many.groupBy(*keys, "chain").applyInPandas(run, f"{kinds}, chain int, {CHAIN_SCHEMA}")


def run_nested(df: DataFrame, keys: Sequence[str], problem: Callable[[pd.DataFrame], Problem], sampler: NestedSampler, seed: int = 0) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = problem(pdf)
        out = sampler.run(p.lnlike, p.transform, p.dimensions, seed_of(seed, *[pdf[k].iloc[0] for k in keys]))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, {NESTED_SCHEMA}")
