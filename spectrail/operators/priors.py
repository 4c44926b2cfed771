"""Priors and their inverse transforms as Columns over theta, and their layout."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions import stats


@dataclass(frozen=True)
class PriorSpec:
    """One parameter's prior: log density and inverse distribution function of a Column."""

    lnpdf: object
    ppf: object


def uniform(low: float, high: float, normalised: bool = True) -> PriorSpec:
    flat = lambda x: F.when((x >= low) & (x <= high), F.lit(0.0)).otherwise(F.lit(stats.NEG_INF))
    return PriorSpec((lambda x: stats.uniform_lnpdf(x, low, high)) if normalised else flat, lambda u: low + (high - low) * u)


def normal(mean: float, sd: float) -> PriorSpec:
    return PriorSpec(lambda x: stats.normal_lnpdf(x, mean, sd), lambda u: mean + sd * stats.probit(u))


def half_normal(scale: float) -> PriorSpec:
    return PriorSpec(lambda x: stats.half_normal_lnpdf(x, scale), lambda u: stats.half_normal_ppf(u, scale))


def resolve(given: PriorSpec | float | tuple[float, float] | None, default: PriorSpec, kind=half_normal) -> PriorSpec:
    """A spec as it is, a number as the kind's scale, a pair as bounds, nothing as the default."""
    if given is None:
        return default
    if isinstance(given, tuple):
        return uniform(*given)
    if isinstance(given, (int, float)):
        return kind(float(given))
    return given


def box(theta: Sequence[Column], limits: Sequence[tuple[float, float]], closed: bool = False) -> Column:
    """0 inside the box, -Infinity outside; improper on purpose. The open box leaves its limits out."""
    inside = F.lit(True)
    for x, (low, high) in zip(theta, limits, strict=True):
        inside = inside & ((x >= low) & (x <= high) if closed else (x > low) & (x < high))
    return F.when(inside, F.lit(0.0)).otherwise(F.lit(stats.NEG_INF))


def ordered(prior: Column, *pairs: tuple[Column, Column]) -> Column:
    """The prior where the first of each pair is the greater."""
    fine = F.lit(True)
    for high, low in pairs:
        fine = fine & (high > low)
    return F.when(fine, prior).otherwise(F.lit(stats.NEG_INF))


def box_transform(u: Sequence[Column], limits: Sequence[tuple[float, float]]) -> list[Column]:
    return [low + (high - low) * x for x, (low, high) in zip(u, limits, strict=True)]


def dirichlet_lnpdf(fractions: Column, species: int) -> Column:
    """ln Gamma(n) for n - 1 positive fractions that leave something for the last, -Infinity else."""
    fine = F.forall(fractions, lambda w: w > 0) & (F.aggregate(fractions, F.lit(0.0), lambda s, w: s + w) < 1)
    return F.when(fine, F.lit(math.lgamma(species))).otherwise(F.lit(stats.NEG_INF))


def dirichlet_transform(u: Column) -> Column:
    """Uniforms to a point of the simplex."""
    e = F.transform(u, lambda x: -F.ln(x))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


@dataclass(frozen=True)
class NoisePrior:
    """Calibration factor (normal in log10, without a Jacobian), covariance weight and length."""

    scale: PriorSpec = field(default_factory=lambda: normal(0.0, 0.01))
    weight: PriorSpec = field(default_factory=lambda: half_normal(0.2))
    length: PriorSpec = field(default_factory=lambda: half_normal(0.1))

    def lnpdf(self, scale: Column, weight: Column, length: Column) -> Column:
        return F.when(scale > 0, self.scale.lnpdf(F.log10(F.when(scale > 0, scale))) + self.weight.lnpdf(weight) + self.length.lnpdf(length)).otherwise(F.lit(stats.NEG_INF))

    def transform(self, u: Sequence[Column]) -> list[Column]:
        return [F.pow(F.lit(10.0), self.scale.ppf(u[0])), self.weight.ppf(u[1]), self.length.ppf(u[2])]


def positive_box(abundances: Column, polynomial: Sequence[Column], bound: float = 10.0) -> Column:
    """Priors of the polynomial models: positive abundances and coefficients within a bound."""
    inside = F.forall(abundances, lambda w: w > 0)
    for p in polynomial:
        inside = inside & (F.abs(p) < bound)
    return F.when(inside, F.lit(0.0)).otherwise(F.lit(stats.NEG_INF))


def all_within(values: Column, bound: float) -> Column:
    return F.when(F.forall(values, lambda v: F.abs(v) < bound), F.lit(0.0)).otherwise(F.lit(stats.NEG_INF))


def joint(*parts: Column) -> Column:
    """The sum of log priors; -Infinity wins over NaN and null."""
    total = F.lit(0.0)
    for p in parts:
        total = total + stats.no_nan(p)
    return total


def sample(df: DataFrame, key: str, specs: Sequence[PriorSpec], seed: int, out: str = "theta") -> DataFrame:
    """Prior draws for each key, the same on any partitioning."""
    return df.withColumn(out, F.array(*[s.ppf(stats.keyed_uniform(F.lit(seed), F.col(key), F.lit(i))) for i, s in enumerate(specs)]))


def normalisation_check(draws: DataFrame, lnprob: str, theta: Sequence[str]) -> DataFrame:
    """log-mean-exp of the prior times the range of each parameter, against the chance of the central half.

    Draws come from the central half of each uniform. Exact for flat priors only, as draws follow the prior.
    """
    top = draws.agg(F.max(lnprob).alias("_top"), *[(F.max(t) - F.min(t)).alias(f"_r{i}") for i, t in enumerate(theta)])
    ranges = sum((F.ln(F.first(f"_r{i}")) for i in range(len(theta))), F.lit(0.0))
    estimate = stats.log_sum_exp(F.col(lnprob), F.col("_top")) - F.ln(F.count(F.lit(1))) + ranges
    return draws.crossJoin(F.broadcast(top)).agg(estimate.alias("estimate"), F.lit(len(theta) * math.log(0.5)).alias("expected"))


def importance_normalisation(draws: DataFrame, lnprob: str, lnproposal: str) -> DataFrame:
    """The mean of p over the density of the draws; 1 for a normalised prior, flat or not."""
    return draws.agg(F.avg(F.exp(F.col(lnprob) - F.col(lnproposal))).alias("mass"))


def bounds(spec_columns: DataFrame, theta: Sequence[str]) -> DataFrame:
    """Least and greatest of each parameter over transforms of the corner points."""
    return spec_columns.agg(*[a for t in theta for a in (F.min(t).alias(f"{t}_min"), F.max(t).alias(f"{t}_max"))])
