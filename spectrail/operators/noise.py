"""Gaussian likelihoods and simulated observations, with and without correlated noise.

Without correlation everything is a Column and one grouped sum. With it, rows of
parameters are scored in Arrow batches: a Cholesky factor per distinct noise
parameters, and where the truncated kernel is not positive definite the determinant's
sign decides, as documented at `lnlike_correlated_np`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions import stats

TRUNCATION = 1e-3


def lnlike_term(observed: Column, model: Column, sigma: Column) -> Column:
    """One point's log-likelihood; -Infinity for NaN or null."""
    z = F.try_divide(observed - model, sigma)
    return stats.no_nan(-0.5 * z * z - stats.safe_ln(sigma) - stats.HALF_LN_2PI)


def lnlike_diagonal(joined: DataFrame, keys: list[str], observed: str, model: str, sigma: str, out: str = "lnlike") -> DataFrame:
    """Summed over the rows of each key."""
    return joined.groupBy(*keys).agg(F.sum(lnlike_term(F.col(observed), F.col(model), F.col(sigma))).alias(out))


def lnlike_joint(parts: list[DataFrame], keys: list[str], out: str = "lnlike") -> DataFrame:
    """The sum over datasets; a key that a dataset lacks has no likelihood there and is -Infinity."""
    stacked = parts[0].select(*keys, out)
    for p in parts[1:]:
        stacked = stacked.unionByName(p.select(*keys, out))
    return stacked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == len(parts), F.sum(stats.no_nan(F.col(out)))).otherwise(F.lit(stats.NEG_INF)).alias(out))


def lnprob(params: DataFrame, lnprior: Column, likelihood: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Prior plus likelihood; rows of zero prior never reach the likelihood and come back as -Infinity."""
    judged = params.withColumn("lnprior", stats.no_nan(lnprior))
    scored = likelihood(judged.where(F.col("lnprior") > stats.NEG_INF)).select(*keys, "lnlike")
    return judged.join(scored, keys, "left").withColumn("lnprob", F.when(F.col("lnlike").isNotNull(), stats.no_nan(F.col("lnprior") + F.col("lnlike"))).otherwise(F.lit(stats.NEG_INF)))


def covariance(wavelength: np.ndarray, sigma: np.ndarray, weight: float, length: float, truncation: float = TRUNCATION) -> np.ndarray:
    """(I + w K) times the outer product of sigma, K squared-exponential with entries below the truncation set to zero."""
    d = wavelength[:, None] - wavelength[None, :]
    if length > 0:
        k = np.exp(-0.5 * (d / length) ** 2)
    else:
        k = (d == 0).astype(float)
    k[k < truncation] = 0.0
    return (np.eye(len(sigma)) + weight * k) * np.outer(sigma, sigma)


def lnlike_correlated_np(residual: np.ndarray, cov: np.ndarray, strict: bool = False) -> float:
    """Cholesky if it exists; else, unless strict, determinant and solve where the determinant is positive, -inf where not."""
    n = len(residual)
    if not np.all(np.isfinite(residual)):
        return -math.inf
    try:
        factor = np.linalg.cholesky(cov)
        z = np.linalg.solve(factor, residual)
        return float(-0.5 * z @ z - np.log(np.diag(factor)).sum() - n * stats.HALF_LN_2PI)
    except np.linalg.LinAlgError:
        if strict:
            return -math.inf
    sign, logdet = np.linalg.slogdet(cov)
    if sign <= 0 or not np.isfinite(logdet):
        return -math.inf
    value = -0.5 * residual @ np.linalg.solve(cov, residual) - 0.5 * logdet - n * stats.HALF_LN_2PI
    return float(value) if np.isfinite(value) else -math.inf


@dataclass(frozen=True)
class Spectrum:
    """One spectrum's unmasked points; a few hundred to a few thousand numbers, shipped once per executor."""

    wavelength: np.ndarray
    value: np.ndarray
    sigma: np.ndarray
    truncation: float = TRUNCATION

    def lnlike(self, theta: np.ndarray, flux: np.ndarray) -> np.ndarray:
        """Rows of noise parameters (scale of the data, weight, length) and of model fluxes at the points.

        Rows that share weight and length share one factor.
        """
        out = np.full(len(theta), -math.inf)
        noise, which = np.unique(theta[:, 1:3], axis=0, return_inverse=True)
        which = which.reshape(-1)
        residual = theta[:, :1] * self.value - flux
        for k, (weight, length) in enumerate(noise):
            rows = np.flatnonzero((which == k) & np.isfinite(residual).all(axis=1))
            if not len(rows):
                continue
            cov = covariance(self.wavelength, self.sigma, weight, length, self.truncation)
            try:
                factor = np.linalg.cholesky(cov)
            except np.linalg.LinAlgError:
                out[rows] = [lnlike_correlated_np(residual[r], cov) for r in rows]
                continue
            z = np.linalg.solve(factor, residual[rows].T)
            out[rows] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum() - len(self.value) * stats.HALF_LN_2PI
        return out

    def simulate(self, theta: np.ndarray, flux: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Draws from N(flux / scale, C); each row's generator has its own seed, so that batches don't matter."""
        out = np.empty_like(flux)
        for i, (scale, weight, length) in enumerate(theta):
            values, vectors = np.linalg.eigh(covariance(self.wavelength, self.sigma, weight, length, self.truncation))
            z = np.random.default_rng(int(seeds[i]) & (2**63 - 1)).standard_normal(len(values))
            out[i] = flux[i] / scale + vectors @ (np.sqrt(np.maximum(values, 0)) * z)
        return out


def lnlike_correlated(params: DataFrame, spectrum: Spectrum, flux: str = "flux", noise: str = "noise", out: str = "lnlike") -> DataFrame:
    """Rows with an array of noise parameters and an array of model fluxes at the spectrum's points."""
    shared = params.sparkSession.sparkContext.broadcast(spectrum)

    @F.pandas_udf("double")
    def run(theta: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(shared.value.lnlike(np.array(theta.tolist(), dtype=float).reshape(-1, 3), np.array(y.tolist(), dtype=float).reshape(len(y), -1)))

    return params.withColumn(out, run(noise, flux))


def lnlike_pair(r1: Column, r2: Column, s1: Column, s2: Column, distance: Column, weight: Column, length: Column, truncation: float = TRUNCATION) -> Column:
    """The correlated likelihood of two points in closed form; -Infinity where the determinant isn't positive."""
    k = F.exp(-0.5 * distance * distance / (length * length))
    k = F.when(k < truncation, 0.0).otherwise(k)
    c11, c22, c12 = (1 + weight) * s1 * s1, (1 + weight) * s2 * s2, weight * k * s1 * s2
    det = c11 * c22 - c12 * c12
    chi = (c22 * r1 * r1 - 2 * c12 * r1 * r2 + c11 * r2 * r2) / det
    return F.when(det > 0, -0.5 * chi - 0.5 * F.ln(det) - 2 * stats.HALF_LN_2PI).otherwise(F.lit(stats.NEG_INF))


def kernel_entries(points: DataFrame, keys: list[str], index: str, wavelength: str, sigma: str, weight: float, length: float, truncation: float = TRUNCATION) -> DataFrame:
    """(i, j, c) of each key's covariance in long form, for few points a key."""
    left = points.select(*keys, F.col(index).alias("i"), F.col(wavelength).alias("_a"), F.col(sigma).alias("_s"))
    right = points.select(*keys, F.col(index).alias("j"), F.col(wavelength).alias("_b"), F.col(sigma).alias("_t"))
    d = F.col("_a") - F.col("_b")
    k = F.exp(-0.5 * d * d / (length * length))
    k = F.when(k < truncation, 0.0).otherwise(k)
    return left.join(right, keys).select(*keys, "i", "j", ((F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) + weight * k) * F.col("_s") * F.col("_t")).alias("c"))


def simulate_diagonal(df: DataFrame, model: str, sigma: str, keys: list[str], seed: int = 0, out: str = "simulated", deviate: Column | None = None) -> DataFrame:
    """Model plus sigma times a normal deviate: the given one, or one keyed by the columns `keys`."""
    z = stats.keyed_normal(F.lit(seed), *[F.col(k) for k in keys]) if deviate is None else deviate
    return df.withColumn(out, F.col(model) + F.col(sigma) * z)


def simulate_batches(params: DataFrame, simulator: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str = "sample_id", theta: str = "theta", seed: int = 0, out: str = "x") -> DataFrame:
    """x for every theta: `simulator(thetas, seeds)` gets whole batches; seeds depend on the key alone."""
    tagged = params.withColumn("_seed", F.xxhash64(F.lit(seed), F.col(key)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in params.schema.fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                x = simulator(np.array(b[theta].tolist(), dtype=float), b["_seed"].to_numpy())
                yield b.drop(columns="_seed").assign(**{out: list(x)})

    return tagged.mapInPandas(run, f"{kinds}, {out} array<double>")


def distinct_models(params: DataFrame, model_columns: list[str], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluate each distinct set of model parameters once and join the results back."""
    return params.join(evaluate(params.select(*model_columns).dropDuplicates()), model_columns)
