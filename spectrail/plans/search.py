"""A fit put together: model, datasets and priors as one posterior, samplers and summaries on top.

The posterior is vectorised NumPy over rows of parameters; Spark runs one task for
each chain or replicate and for each batch of predictive draws.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions import stats
from spectrail.operators import diagnostics, noise, samplers
from spectrail.operators.align import RESAMPLERS
from spectrail.operators.models import ModelSpec
from spectrail.plans.layout import ParamLayout


@dataclass(frozen=True)
class Prior:
    """One parameter's log density and inverse distribution function on arrays."""

    lnpdf: Callable[[np.ndarray], np.ndarray]
    ppf: Callable[[np.ndarray], np.ndarray]


def _quantile(u: np.ndarray) -> np.ndarray:
    inverse = NormalDist().inv_cdf
    return np.array([inverse(min(max(float(x), 1e-300), 1 - 1e-16)) for x in np.ravel(u)]).reshape(np.shape(u))


def uniform(low: float, high: float) -> Prior:
    return Prior(lambda x: np.where((x >= low) & (x <= high), -np.log(high - low), -np.inf), lambda u: low + (high - low) * u)


def normal(mean: float, sd: float) -> Prior:
    return Prior(lambda x: -0.5 * ((x - mean) / sd) ** 2 - np.log(sd) - stats.HALF_LN_2PI, lambda u: mean + sd * _quantile(u))


def half_normal(scale: float) -> Prior:
    return Prior(lambda x: np.where(x >= 0, 0.5 * np.log(2 / np.pi) - np.log(scale) - x * x / (2 * scale * scale), -np.inf), lambda u: scale * _quantile((1 + u) / 2))


def log10_normal(sd: float) -> Prior:
    """Normal in log10, without a Jacobian."""

    def lnpdf(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.where(x > 0, -0.5 * (np.log10(np.where(x > 0, x, 1)) / sd) ** 2 - np.log(sd) - stats.HALF_LN_2PI, -np.inf)

    return Prior(lnpdf, lambda u: 10 ** (sd * _quantile(u)))


@dataclass(frozen=True)
class Photometry:
    """Band fluxes with independent errors; `bands` turns a model on the grid into band fluxes by one product."""

    name: str
    bands: np.ndarray  # filters x grid
    value: np.ndarray
    sigma: np.ndarray
    priors: tuple[Prior, ...] = ()
    labels: tuple[str, ...] = ()

    def lnlike(self, theta: np.ndarray, grid: np.ndarray, flux: np.ndarray) -> np.ndarray:
        z = (self.value - flux @ self.bands.T) / self.sigma
        return -0.5 * (z * z).sum(axis=1) - np.log(self.sigma).sum() - len(self.value) * stats.HALF_LN_2PI

    def simulate(self, theta: np.ndarray, grid: np.ndarray, flux: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return flux @ self.bands.T + self.sigma * rng.standard_normal((len(flux), len(self.value)))


def band_matrix(grid: np.ndarray, filters: Sequence[tuple[np.ndarray, np.ndarray, str]]) -> np.ndarray:
    """Rows of weights for filters of (wavelength, transmission, detector): the band mean of F_nu / x^2 times the pivot squared."""
    step = np.zeros(len(grid))
    step[1:] += np.diff(grid) / 2
    step[:-1] += np.diff(grid) / 2
    rows = []
    for w, t, detector in filters:
        weight = np.interp(grid, w, t, left=0, right=0) * (grid if detector == "photon" else 1) * step / grid**2
        rows.append(weight / weight.sum())
    return np.array(rows)


@dataclass(frozen=True)
class SpectrumData:
    """A spectrum with a calibration factor and correlated noise; masked points are left out after resampling."""

    name: str
    wavelength: np.ndarray
    value: np.ndarray
    sigma: np.ndarray
    mask: np.ndarray | None = None
    resample: str | Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = "fast"
    priors: tuple[Prior, ...] = field(default_factory=lambda: (log10_normal(0.01), half_normal(0.2), half_normal(0.1)))
    labels: tuple[str, ...] = ("calibration", "weight", "length")

    def _kept(self) -> tuple[np.ndarray, noise.Spectrum]:
        keep = np.ones(len(self.wavelength), dtype=bool) if self.mask is None else self.mask
        return keep, noise.Spectrum(self.wavelength[keep], self.value[keep], self.sigma[keep])

    def _at(self, grid: np.ndarray, flux: np.ndarray, keep: np.ndarray) -> np.ndarray:
        f = RESAMPLERS[self.resample] if isinstance(self.resample, str) else self.resample
        # All bins are made before any is masked: their edges depend on masked neighbours.
        return np.array([f(self.wavelength, grid, row) for row in flux]).reshape(len(flux), -1)[:, keep]

    def lnlike(self, theta: np.ndarray, grid: np.ndarray, flux: np.ndarray) -> np.ndarray:
        keep, spectrum = self._kept()
        return spectrum.lnlike(theta, self._at(grid, flux, keep))

    def simulate(self, theta: np.ndarray, grid: np.ndarray, flux: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        keep, spectrum = self._kept()
        return spectrum.simulate(theta, self._at(grid, flux, keep), rng.integers(0, 2**62, len(theta)))


@dataclass(frozen=True)
class Search:
    """Everything a sampler needs; parameters are the model's, then each dataset's."""

    model: ModelSpec
    grid: np.ndarray
    model_priors: tuple[Prior, ...]
    datasets: tuple[Photometry | SpectrumData, ...]
    #: Takes the place of the sum of the priors, if given; transforms stay those of the priors.
    own_lnprior: Callable[[np.ndarray], np.ndarray] | None = None

    @property
    def layout(self) -> ParamLayout:
        return ParamLayout.of((len(self.model_priors), list(self.model.labels)), [(d.name, len(d.priors), list(d.labels)) for d in self.datasets])

    @property
    def priors(self) -> tuple[Prior, ...]:
        return tuple(p for part in (self.model_priors, *[d.priors for d in self.datasets]) for p in part)

    def lnprior(self, theta: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            total = self.own_lnprior(theta) if self.own_lnprior else sum(p.lnpdf(theta[:, i]) for i, p in enumerate(self.priors))
        return np.where(np.isnan(total), -np.inf, total)

    def transform(self, u: np.ndarray) -> np.ndarray:
        return np.column_stack([p.ppf(u[:, i]) for i, p in enumerate(self.priors)])

    def flux(self, theta: np.ndarray) -> np.ndarray:
        return self.model.flux_np(self.grid, theta[:, : len(self.model_priors)])

    def lnlike(self, theta: np.ndarray) -> np.ndarray:
        flux, at, total = self.flux(theta), len(self.model_priors), np.zeros(len(theta))
        for d in self.datasets:
            total = total + d.lnlike(theta[:, at : at + len(d.priors)], self.grid, flux)
            at += len(d.priors)
        return np.where(np.isnan(total), -np.inf, total)

    def lnprob(self, theta: np.ndarray) -> np.ndarray:
        """Only rows the prior allows are evaluated."""
        out = self.lnprior(theta)
        allowed = out > -np.inf
        if allowed.any():
            out[allowed] += self.lnlike(theta[allowed])
        return np.where(np.isnan(out), -np.inf, out)

    def simulate(self, theta: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """All datasets' simulated values, end to end; each distinct set of model parameters is evaluated once."""
        n = len(self.model_priors)
        distinct, which = np.unique(theta[:, :n], axis=0, return_inverse=True)
        flux, at, out = self.model.flux_np(self.grid, distinct)[which.reshape(-1)], n, []
        for d in self.datasets:
            out.append(d.simulate(theta[:, at : at + len(d.priors)], self.grid, flux, rng))
            at += len(d.priors)
        return np.concatenate(out, axis=1)

    def observed(self) -> np.ndarray:
        return np.concatenate([d.value if isinstance(d, Photometry) or d.mask is None else d.value[d.mask] for d in self.datasets])

    def _problem(self, guess: np.ndarray | None) -> samplers.Problem:
        n = len(self.priors)
        return samplers.Problem(self.lnprob, n, guess, lambda k, rng: self.transform(rng.random((k, n))), self.lnlike, self.transform)

    def sample(self, spark: SparkSession, sampler: samplers.EnsembleMCMC | samplers.EnsembleSlice, chains: int = 1, guess: np.ndarray | None = None, seed: int = 0) -> DataFrame:
        """Chains: run_id, chain, walker, step, theta, lnprob, accepted. Without a guess walkers start from the prior."""
        one = spark.createDataFrame([("run",)], "run_id string")
        return samplers.run_chains(one, ["run_id"], lambda pdf: self._problem(guess), sampler, chains, seed)

    def nested(self, spark: SparkSession, sampler: samplers.NestedSampler, replicates: int = 1, seed: int = 0) -> DataFrame:
        runs = spark.range(replicates).select(F.col("id").alias("run_id"))
        return samplers.run_nested(runs, ["run_id"], lambda pdf: self._problem(None), sampler, seed)

    def simulations(self, spark: SparkSession, thetas: np.ndarray | None = None, n: int = 1000, seed: int = 0) -> DataFrame:
        """sample_id, theta, x: simulated data for given parameters or prior draws, keyed by sample, over as many tasks as the session has."""
        parts = min(n if thetas is None else len(thetas), 4 * spark.sparkContext.defaultParallelism)
        if thetas is None:
            k = len(self.priors)

            def draw(it):
                for b in it:
                    if len(b):
                        u = np.array([samplers.seed_of(seed, "prior", int(i)).random(k) for i in b["sample_id"]])
                        yield pd.DataFrame({"sample_id": b["sample_id"], "theta": list(self.transform(u))})

            params = spark.range(0, n, 1, parts).select(F.col("id").alias("sample_id")).mapInPandas(draw, "sample_id long, theta array<double>")
        else:
            params = spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(len(thetas)), "theta": [t.tolist() for t in thetas]}), "sample_id long, theta array<double>").repartition(parts, "sample_id")
        one = lambda theta, seeds: np.concatenate([self.simulate(t[None], samplers.seed_of(seed, "noise", int(s))) for t, s in zip(theta, seeds, strict=True)])
        return noise.simulate_batches(params, one, seed=seed)

    def infer_from_simulations(self, spark: SparkSession, sampler: samplers.SequentialPosterior, seed: int = 0, cached: DataFrame | None = None) -> DataFrame:
        """Draws of a posterior learned from simulations: run_id, sample_id, theta.

        Each round's simulations run over tasks and come back as moments. `cached` (theta and x, as `simulations` makes
        and Parquet keeps) takes the place of the first round's.
        """
        p, now, fitted, made = len(self.priors), None, None, cached
        observed = self.observed()[None]
        for round_ in range(sampler.rounds):
            rng = samplers.seed_of(seed, "round", round_)
            if round_:
                thetas = samplers.draw_gaussian(now, lambda t: self.lnprior(t) > -np.inf, sampler.simulations, rng)
                made = self.simulations(spark, thetas, seed=seed + round_)
            elif made is None:
                made = self.simulations(spark, n=sampler.simulations, seed=seed)
            # Off the observation and off the prior's middle, so that sums of squares keep their digits.
            offset, middle = sampler.embedded(observed)[0], self.transform(np.full((1, p), 0.5))[0]

            def partial(it):
                for b in it:
                    if len(b):
                        n, total, products = samplers.moments(np.array(b["theta"].tolist()) - middle, sampler.embedded(np.array(b["x"].tolist())) - offset)
                        yield pd.DataFrame({"n": [n], "total": [total.tolist()], "products": [products.ravel().tolist()]})

            rows = made.select("theta", "x").mapInPandas(partial, "n long, total array<double>, products array<double>").collect()
            m = len(rows[0]["total"])
            found = samplers.fit_posterior_of(sum(r["n"] for r in rows), sum(np.array(r["total"]) for r in rows), sum(np.array(r["products"]).reshape(m, m) for r in rows), p, sampler.features)
            weights = found.weights.copy()
            weights[0] += middle
            fitted = samplers.GaussianPosterior(weights, found.covariance, found.basis, found.centre + offset)
            now = sampler.next_posterior(fitted, observed, now)
        if sampler.nearest >= 1:
            draws = samplers.draw_gaussian(now, lambda t: self.lnprior(t) > -np.inf, sampler.draws, samplers.seed_of(seed, "draws"))
            return spark.createDataFrame(pd.DataFrame({"run_id": 0, "sample_id": np.arange(len(draws)), "theta": [t.tolist() for t in draws]}), "run_id long, sample_id long, theta array<double>")
        return self._nearest(made, fitted, sampler, seed)

    def _nearest(self, made: DataFrame, fitted: samplers.GaussianPosterior, sampler: samplers.SequentialPosterior, seed: int) -> DataFrame:
        """Draws with replacement from the simulations nearest to the observation, moved along the regression."""
        observed = sampler.embedded(self.observed())

        def move(it):
            for b in it:
                if len(b):
                    theta, far = samplers.moved(fitted, np.array(b["theta"].tolist()), sampler.embedded(np.array(b["x"].tolist())), observed)
                    allowed = self.lnprior(theta) > -np.inf
                    yield pd.DataFrame({"sample_id": b["sample_id"][allowed], "theta": list(theta[allowed]), "far": far[allowed]})

        rows = made.select("sample_id", "theta", "x").mapInPandas(move, "sample_id long, theta array<double>, far double").withColumn("run_id", F.lit(0).cast("long"))
        edge = rows.groupBy("run_id").agg(F.percentile_approx("far", F.lit(sampler.nearest), F.lit(100_000)).alias("edge"))
        near = rows.join(F.broadcast(edge), "run_id").where("far < edge").withColumn("weight", 1 - F.pow(F.col("far") / F.col("edge"), F.lit(2.0)))
        offset = F.lit(float(samplers.seed_of(seed, "offset").random()))
        drawn = diagnostics.systematic_resample(near, ["run_id"], "weight", ["sample_id"], sampler.draws, offset)
        return drawn.select("run_id", F.col("draw").alias("sample_id"), "theta")

    def with_parts(self, **changes) -> Search:
        """The same search with another model, grid, priors or datasets; samplers are rebuilt from it."""
        return replace(self, **changes)

    def post_process(self, spark: SparkSession, chains: DataFrame, walkers: int, steps: int, path: str | None = None, draws: int = 100, seed: int = 0) -> dict[str, DataFrame]:
        """All that follows a run: summary, trace, log-probabilities by step and predictive band; with a path also a text report there."""
        from spectrail.plans import views

        labels = list(self.layout.labels)
        order = [c for c in ("run_id", "chain", "step", "walker") if c in chains.columns]
        drawn = diagnostics.draw_rows(chains.select(*order, "theta").withColumn("_all", F.lit(0)), ["_all"], order, draws, seed)
        out = {
            "summary": self.summary(chains, walkers, steps),
            "trace": views.trace(chains, labels),
            "lnprob": chains.groupBy("step").agg(F.avg("lnprob").alias("lnprob"), F.max("lnprob").alias("best")),
            "predictive": diagnostics.predictive_band(self.predictive(drawn.withColumnRenamed("draw", "sample_id")), ["grid_idx", "wavelength"], "flux"),
        }
        if path:
            diagnostics.write_report(out["summary"], path)
        return out

    def __call__(self, spark: SparkSession, sampler, guess: np.ndarray | None = None, path: str | None = None, seed: int = 0) -> dict[str, DataFrame]:
        """Sample with an ensemble sampler and post-process; `chains` are among the results."""
        chains = self.sample(spark, sampler, guess=guess, seed=seed)
        return {"chains": chains, **self.post_process(spark, chains, sampler.walkers, sampler.steps - sampler.burn_in, path, seed=seed)}

    def summary(self, chains: DataFrame, walkers: int, steps: int) -> DataFrame:
        return diagnostics.summary(chains, list(self.layout.labels), walkers, steps)

    def predictive(self, draws: DataFrame, key: str = "sample_id") -> DataFrame:
        """Model curves of draws with a theta column: key, grid_idx, wavelength, flux."""
        points = F.array(*[F.lit(float(x)) for x in self.grid])

        def run(it):
            for b in it:
                if len(b):
                    yield pd.DataFrame({key: b[key], "flux": list(self.flux(np.array(b["theta"].tolist())))})

        curves = draws.select(key, "theta").mapInPandas(run, f"{key} {draws.schema[key].dataType.simpleString()}, flux array<double>")
        return curves.select(key, F.posexplode(F.arrays_zip(points.alias("wavelength"), F.col("flux"))).alias("grid_idx", "p")).select(key, "grid_idx", "p.wavelength", "p.flux")
