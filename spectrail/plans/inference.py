"""Queries on sampling, simulation, priors and extinction whose results SQL knows exactly.

Where an operator draws random numbers, the query returns the exact values and says
whether the draws agree with them within several of their standard errors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions import stats
from spectrail.operators import align, diagnostics, models, noise, priors, samplers
from spectrail.plans import posteriors
from spectrail.plans.inputs import SPECTRA_SQL, spectra, table, uniform, uniform_sql

N_POINTS = len(posteriors.LINE_X)
S_XX = float(((posteriors.LINE_X - posteriors.LINE_X.mean()) ** 2).sum())
SLOPE_SD = posteriors.LINE_SD / math.sqrt(S_XX)

LINES_SQL = f"""
{SPECTRA_SQL}, m AS (SELECT label, k, avg(y) AS y FROM s JOIN embeddings USING (vec_id) WHERE k BETWEEN 8 AND 47 GROUP BY ALL),
l AS (SELECT label, regr_slope(y, k) AS slope, regr_intercept(y, k) AS intercept, regr_syy(y, k) - regr_slope(y, k) * regr_sxy(y, k) AS rest FROM m GROUP BY 1)
"""


def _exact_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's least-squares line, the posterior's mean, and the sum of squares that it leaves."""
    rows = posteriors._line_objects(spark, sf).select("label", F.posexplode("y").alias("i", "y")).withColumn("k", F.col("i") + float(posteriors.LINE_X[0]))
    slope, intercept = F.regr_slope("y", "k"), F.regr_intercept("y", "k")
    return rows.groupBy("label").agg(slope.alias("exact_slope"), intercept.alias("exact_intercept"), (F.regr_syy("y", "k") - slope * F.regr_sxy("y", "k")).alias("rest"))


def _agreement(sampled: DataFrame, exact: DataFrame, mean_errors: float, sd_part: float, *more: Column) -> DataFrame:
    """The exact line, and whether the sampled mean is within `mean_errors` posterior deviations and the deviation within a part."""
    joined = sampled.join(exact, "label")
    mean_ok = F.abs(F.col("slope") - F.col("exact_slope")) < mean_errors * SLOPE_SD
    sd_ok = F.abs(F.col("slope_sd") / SLOPE_SD - 1) < sd_part
    return joined.select("label", F.round("exact_slope", 6).alias("slope"), F.round("exact_intercept", 6).alias("intercept"), mean_ok.alias("mean_ok"), sd_ok.alias("sd_ok"), *more)


AGREEMENT_SQL = f"WITH {LINES_SQL} SELECT label, round(slope, 6) AS slope, round(intercept, 6) AS intercept, true AS mean_ok, true AS sd_ok FROM l"


def mcmc_line_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(posteriors.mcmc_line(spark, sf), _exact_lines(spark, sf), 0.4, 0.3)


MCMC_LINE_EXACT = AGREEMENT_SQL


def slice_line_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(posteriors.slice_line(spark, sf), _exact_lines(spark, sf), 0.4, 0.3)


SLICE_LINE_EXACT = AGREEMENT_SQL


def lfi_line_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(posteriors.lfi_line(spark, sf), _exact_lines(spark, sf), 0.5, 0.4)


LFI_LINE_EXACT = AGREEMENT_SQL

#: ln Z of a line whose prior is flat over ten by ten, but for the squares that its best fit leaves.
LINE_LNZ = -N_POINTS * (math.log(posteriors.LINE_SD) + stats.HALF_LN_2PI) + math.log(2 * math.pi * posteriors.LINE_SD**2 / math.sqrt(N_POINTS * S_XX)) - math.log(100)


def _nested(spark: SparkSession, sf: str, sampler: samplers.NestedSampler, seed: int) -> DataFrame:
    out = samplers.run_nested(posteriors._line_objects(spark, sf), ["label"], posteriors._line_problem, sampler, seed=seed)
    last = diagnostics.evidence(out, ["label"], "logwt")
    weighted = out.drop("logz").join(last, "label").withColumn("w", F.exp(F.col("logwt") - F.col("logz"))).withColumn("slope", F.col("theta")[0])
    moments = diagnostics.weighted_moments(weighted, ["label"], "w", ["slope"]).select("label", F.col("mean_slope").alias("slope"), F.sqrt("cov_slope_slope").alias("slope_sd"))
    exact = F.lit(LINE_LNZ) - F.col("rest") / (2 * posteriors.LINE_SD**2)
    return _agreement(moments.join(last, "label"), _exact_lines(spark, sf), 0.6, 0.4, F.round(exact, 4).alias("ln_z"), (F.abs(F.col("logz") - exact) < 2.0).alias("ln_z_ok"))


NESTED_SQL = f"WITH {LINES_SQL} SELECT label, round(slope, 6) AS slope, round(intercept, 6) AS intercept, true AS mean_ok, true AS sd_ok, round({LINE_LNZ!r}::DOUBLE - rest / {2 * posteriors.LINE_SD**2!r}::DOUBLE, 4) AS ln_z, true AS ln_z_ok FROM l"


def nested_line_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf, samplers.NestedSampler(150, 0.1), 13)


NESTED_LINE_EXACT = NESTED_SQL


def dynamic_nested_line_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf, samplers.DynamicNestedSampler(120, 0.1, strands=3, more=60), 14)


DYNAMIC_NESTED_LINE_EXACT = NESTED_SQL


def nested_two_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Two far modes of equal weight for each label, sampled static and dynamic; the evidence is that of the flat prior."""

    def problem(pdf: pd.DataFrame) -> samplers.Problem:
        label = float(pdf["label"].iloc[0])
        centre, sd = np.array([1.5 + 0.1 * label, -2.0]), 0.08 + 0.01 * label

        def like(t: np.ndarray) -> np.ndarray:
            parts = [-0.5 * (((t - m) / sd) ** 2).sum(axis=1) for m in (centre, -centre)]
            return np.logaddexp(*parts) - math.log(2) - 2 * (math.log(sd) + stats.HALF_LN_2PI)

        return samplers.Problem(like, 2, None, None, like, lambda u: -5 + 10 * u)

    labels = table(spark, sf, "embeddings").select("label").distinct()
    parts = []
    for name, sampler in (("static", samplers.NestedSampler(150, 0.1)), ("dynamic", samplers.DynamicNestedSampler(100, 0.1, strands=3, more=60))):
        out = samplers.run_nested(labels, ["label"], problem, sampler, seed=15)
        last = diagnostics.evidence(out, ["label"], "logwt")
        share = F.sum(F.when(F.col("theta")[0] > 0, F.exp(F.col("logwt") - F.col("logz"))).otherwise(0.0))
        parts.append(out.drop("logz").join(last, "label").groupBy("label").agg(F.first("logz").alias("logz"), share.alias("share")).withColumn("sampler", F.lit(name)))
    exact = -math.log(100)
    both = parts[0].unionByName(parts[1])
    return both.select("label", "sampler", F.lit(round(exact, 6)).alias("ln_z"), (F.abs(F.col("logz") - exact) < 1.5).alias("ln_z_ok"), (F.abs(F.col("share") - 0.5) < 0.3).alias("share_ok"))


NESTED_TWO_MODES = "SELECT label, sampler, round(-ln(100), 6) AS ln_z, true AS ln_z_ok, true AS share_ok FROM (SELECT DISTINCT label FROM embeddings), (VALUES ('static'), ('dynamic')) v(sampler)"


def draws_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Draws with replacement: how many, all from the table, and as many distinct ones as chance has."""
    rows = table(spark, sf, "events").select("event_type", "event_id", "value")
    drawn = diagnostics.draw_rows(rows, ["event_type"], ["event_id"], 200, 7)
    known = drawn.join(rows.withColumnRenamed("value", "own"), ["event_type", "event_id"]).where(F.col("own").eqNullSafe(F.col("value")))
    n = rows.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("rows"))
    counted = known.groupBy("event_type").agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("event_id").alias("distinct")).join(n, "event_type")
    expected = F.col("rows") * (1 - F.pow(1 - 1 / F.col("rows"), F.lit(200.0)))
    return counted.select("event_type", "draws", F.round(expected, 4).alias("expected_distinct"), (F.abs(F.col("distinct") - expected) < 6 * F.sqrt(200 * F.greatest(1 - expected / 200, F.lit(0.02)))).alias("distinct_ok"))


DRAWS_EXACT = "SELECT event_type, 200::BIGINT AS draws, round(n * (1 - pow(1 - 1 / n, 200)), 4) AS expected_distinct, true AS distinct_ok FROM (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1)"


def lnlike_corr_banded(spark: SparkSession, sf: str) -> DataFrame:
    """The dense likelihood of every spectrum where truncation leaves the kernel neighbours only, so that SQL can factor it."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("flux"))
    spectrum = noise.Spectrum(np.arange(64, dtype=float), np.zeros(64), np.full(64, 0.5))
    sets = ((1.0, 0.0, 1.0), (1.0, 0.2, 0.5), (0.98, 0.5, 0.45))
    params = rows.select("vec_id", "flux", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, t)).alias("noise")) for i, t in enumerate(sets)])).alias("n")).select("vec_id", "flux", F.col("n.i").alias("noise_set"), F.col("n.noise").alias("noise"))
    return noise.lnlike_correlated(params, spectrum).select("vec_id", "noise_set", F.round("lnlike", 6).alias("lnlike"))


#: A tridiagonal matrix by its pivots: each takes the neighbour's part off the diagonal and off what is left.
LNLIKE_CORR_BANDED = """
WITH RECURSIVE n AS (SELECT * FROM (VALUES (0, 0.25::DOUBLE, 0.0::DOUBLE), (1, 0.25::DOUBLE * 1.2, 0.25::DOUBLE * 0.2 * exp(-0.5 / 0.25)), (2, 0.25::DOUBLE * 1.5, 0.25::DOUBLE * 0.5 * exp(-0.5::DOUBLE / (0.45::DOUBLE * 0.45::DOUBLE)))) v(noise_set, a, c)),
t AS (
  SELECT vec_id, noise_set, a, c, embedding AS e, 1 AS k, a AS p, embedding[1]::DOUBLE AS z, embedding[1]::DOUBLE * embedding[1]::DOUBLE / a + ln(a) AS total FROM embeddings, n
  UNION ALL
  SELECT vec_id, noise_set, a, c, e, k + 1, a - c * c / p, e[k + 1]::DOUBLE - c / p * z, total + pow(e[k + 1]::DOUBLE - c / p * z, 2) / (a - c * c / p) + ln(a - c * c / p) FROM t WHERE k < 64
)
SELECT vec_id, noise_set, round(-0.5 * total - 32 * ln(2 * pi()), 6) AS lnlike FROM t WHERE k = 64
"""


def simulate_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated noise about each label's mean spectrum, in batches keyed by sample: variance and neighbours' covariance."""
    weight, length, draws = 0.4, 1.5, 400
    spectrum = noise.Spectrum(np.arange(40, dtype=float), np.zeros(40), np.full(40, 0.5))
    objects = posteriors._line_objects(spark, sf)
    params = objects.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("label", (F.col("label") * draws + F.col("draw")).alias("sample_id"), F.col("y").alias("theta"))
    made = noise.simulate_batches(params, lambda flux, seeds: spectrum.simulate(np.tile([1.0, weight, length], (len(flux), 1)), flux, seeds), seed=5)
    rest = F.zip_with("x", "theta", lambda x, y: x - y)
    pairs = made.select("label", F.posexplode(F.arrays_zip(rest.alias("r"), F.concat(F.slice(rest, 2, 39), F.array(F.lit(0.0))).alias("next"))).alias("k", "p"))
    got = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p.r") * F.col("p.r")).alias("var"), (F.sum(F.col("p.r") * F.col("p.next")) / (39 * draws)).alias("cov"), F.avg("p.r").alias("mean"))
    var, cov = 0.25 * (1 + weight), 0.25 * weight * math.exp(-0.5 / length**2)
    return got.select("label", "n", F.lit(round(var, 6)).alias("variance"), F.lit(round(cov, 6)).alias("covariance"), (F.abs(F.col("mean")) < 0.05).alias("mean_ok"), (F.abs(F.col("var") / var - 1) < 0.1).alias("variance_ok"), (F.abs(F.col("cov") / cov - 1) < 0.25).alias("covariance_ok"))


SIMULATE_SPECTRA = "SELECT label, 16000::BIGINT AS n, round(0.25::DOUBLE * 1.4, 6) AS variance, round(0.25::DOUBLE * 0.4 * exp(-0.5 / 2.25), 6) AS covariance, true AS mean_ok, true AS variance_ok, true AS covariance_ok FROM (SELECT DISTINCT label FROM embeddings)"


def resample_own(spark: SparkSession, sf: str) -> DataFrame:
    """A resampler of the user's own: the nearest sample, of two as near the later."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: 6.5 * j + uniform(F.col("vec_id"), j))
    rows = table(spark, sf, "embeddings").select("vec_id", grid.alias("x"), F.col("embedding").cast("array<double>").alias("y"), wanted.alias("at"))
    out = align.resample_arrays(rows, "x", "y", "at", "z", lambda new_x, x, y: np.asarray(y)[np.searchsorted((np.asarray(x)[1:] + np.asarray(x)[:-1]) / 2, new_x, side="right")])
    return out.select("vec_id", F.posexplode("z").alias("j", "z")).select("vec_id", "j", F.round("z", 6).alias("z"))


RESAMPLE_OWN = f"SELECT vec_id, CAST(j AS INT) AS j, round(embedding[CAST(floor(6.5::DOUBLE * j + {uniform_sql('vec_id', 'j')} + 0.5) AS INT) + 1]::DOUBLE, 6) AS z FROM embeddings, range(10) r(j)"


def _uniforms(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", *[uniform(F.col("c_custkey"), i).alias(f"u{i}") for i in range(n)])


def prior_transform_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Noise parameters by inverse distribution functions, taken back by the distributions themselves."""
    scale, weight, length = priors.NoisePrior().transform([F.col(f"u{i}") for i in range(3)])

    @F.pandas_udf("double")
    def erf(x: pd.Series) -> pd.Series:
        return x.map(math.erf)

    drawn = _uniforms(spark, sf, 3).select("c_custkey", scale.alias("a"), weight.alias("w"), length.alias("l"))
    back = (0.5 + 0.5 * erf(F.log10("a") / 0.01 / math.sqrt(2)), erf(F.col("w") / 0.2 / math.sqrt(2)), erf(F.col("l") / 0.1 / math.sqrt(2)))
    return drawn.select("c_custkey", *[F.floor(b * 10007).alias(n) for b, n in zip(back, ("scale", "weight", "length"), strict=True)])


#: Uniforms are the middles of 10007 equal parts.
PRIOR_TRANSFORM_NOISE = "SELECT c_custkey, " + ", ".join(f"CAST((c_custkey::BIGINT * 7919 + {i} * 104729) % 10007 AS BIGINT) AS {n}" for i, n in enumerate(("scale", "weight", "length"))) + " FROM customer"


def prior_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Prior draws keyed by customer: resolved from a spec, a number, bounds and nothing."""
    specs = [priors.resolve(x, priors.normal(3.0, 2.0)) for x in (priors.normal(1.0, 0.5), 0.3, (2.0, 6.0), None)]
    drawn = priors.sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", specs, seed=3)
    got = drawn.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("theta")[i]).alias(f"{n}{i}") for i in range(4) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    half = 0.3 * math.sqrt(2 / math.pi)
    exact = [(1.0, 0.5), (half, 0.3 * math.sqrt(1 - 2 / math.pi)), (4.0, 4 / math.sqrt(12)), (3.0, 2.0)]
    ok = [((F.abs(F.col(f"m{i}") - m) < 6 * s / F.sqrt("n")) & (F.abs(F.col(f"s{i}") / s - 1) < 8 / F.sqrt("n"))).alias(f"ok{i}") for i, (m, s) in enumerate(exact)]
    return got.select("n", F.lit(round(half, 6)).alias("half_normal_mean"), *ok)


PRIOR_SAMPLES = "SELECT count(*) AS n, round(0.3::DOUBLE * sqrt(2 / pi()), 6) AS half_normal_mean, true AS ok0, true AS ok1, true AS ok2, true AS ok3 FROM customer"


def prior_positive_box(spark: SparkSession, sf: str) -> DataFrame:
    """Positive abundances with bounded coefficients; a Dirichlet prior with a uniform one beside it; two models' priors together."""
    rows = _uniforms(spark, sf, 4).select("c_custkey", *[(F.col(f"u{i}") - 0.2).alias(f"v{i}") for i in range(4)])
    fractions = F.array(F.col("v0"), F.col("v1"))
    positive = priors.positive_box(fractions, [F.col("v2") * 20, F.col("v3") * 15])
    mixed = priors.joint(priors.dirichlet_lnpdf(fractions, 3), priors.uniform(-0.1, 0.5).lnpdf(F.col("v2")))
    both = priors.joint(positive, mixed)
    finite = lambda c, n: F.when(c > stats.NEG_INF, F.round(c, 8)).alias(n)
    return rows.select("c_custkey", finite(positive, "positive"), finite(mixed, "mixed"), finite(both, "composite"))


def _positive_sql() -> str:
    u = ", ".join(f"{uniform_sql('c_custkey', i)} - 0.2::DOUBLE AS v{i}" for i in range(4))
    return f"""
WITH v AS (SELECT c_custkey, {u} FROM customer), p AS (SELECT c_custkey, CASE WHEN v0 > 0 AND v1 > 0 AND abs(v2 * 20) < 10 AND abs(v3 * 15) < 10 THEN 0.0::DOUBLE END AS positive,
  CASE WHEN v0 > 0 AND v1 > 0 AND v0 + v1 < 1 AND v2 >= -0.1 AND v2 <= 0.5 THEN round(ln(2) - ln(0.6::DOUBLE), 8) END AS mixed FROM v)
SELECT c_custkey, positive, mixed, positive + mixed AS composite FROM p
"""


PRIOR_POSITIVE_BOX = _positive_sql()


def chain_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The report's table over all events as a chain of one parameter, without the autocorrelation time."""
    step = F.row_number().over(diagnostics.W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("walker"), step.alias("step"), F.array("value").alias("theta"), (-F.abs(F.round("value") - 250)).alias("lnprob"), (F.col("value") > 100).alias("accepted"))
    out = diagnostics.summary(rows, ["value"], 10, 100).where(~F.col("statistic").isin("tau", "ess"))
    return out.select("statistic", "parameter", F.round("value", 6).alias("value"))


CHAIN_SUMMARY = """
WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
q AS (SELECT quantile_cont(value, 0.16) AS l, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.84) AS h FROM c),
g AS (SELECT value, (step - (SELECT min(step) FROM c))::DOUBLE / ((SELECT max(step) FROM c) - (SELECT min(step) FROM c) + 1) AS p FROM c),
z AS (SELECT (avg(value) FILTER (p < 0.1) - avg(value) FILTER (p >= 0.5)) / sqrt(var_pop(value) FILTER (p < 0.1) + var_pop(value) FILTER (p >= 0.5)) AS z FROM g),
t AS (SELECT user_id, value, ntile(2) OVER (PARTITION BY user_id ORDER BY step) AS h FROM c),
b AS (SELECT user_id, h, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM t GROUP BY ALL),
r AS (SELECT sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS r FROM b),
k AS (SELECT value FROM c QUALIFY row_number() OVER (ORDER BY -abs(round(value) - 250) DESC, user_id, step) = 1)
SELECT 'median' AS statistic, 'value' AS parameter, round(m, 6) AS value FROM q UNION ALL SELECT 'plus', 'value', round(h - m, 6) FROM q UNION ALL SELECT 'minus', 'value', round(m - l, 6) FROM q
UNION ALL SELECT 'z', 'value', round(z, 6) FROM z UNION ALL SELECT 'rhat', 'value', round(r, 6) FROM r UNION ALL SELECT 'map', 'value', round(value, 6) FROM k
UNION ALL SELECT 'acceptance', NULL, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM c
"""


def f99_extinction(spark: SparkSession, sf: str) -> DataFrame:
    """Dimming by curves with both parameters free, one fixed, or both, from the far ultraviolet to the infrared."""
    rows = table(spark, sf, "customer").select("c_custkey", *[uniform(F.col("c_custkey"), i).alias(f"u{i}") for i in range(3)])
    w = F.pow(F.lit(10.0), -0.9 + 1.9 * F.col("u0"))
    free = models.F99Extinction()
    a_v, r_v = free.transform([F.col("u1"), F.col("u2")], (0.0, 3.0), (2.0, 6.0))
    theta = rows.select("c_custkey", w.alias("w"), a_v.alias("a_v"), r_v.alias("r_v"))
    fixed = models.F99Extinction(a_v=1.0)
    return theta.select(
        "c_custkey",
        F.round(free.factor(F.col("w"), [F.col("a_v"), F.col("r_v")]), 6).alias("free"),
        F.round(fixed.factor(F.col("w"), [F.col("r_v")]), 6).alias("fixed"),
        (free.lnprior([F.col("a_v"), F.col("r_v")], (0.5, 2.0), (2.5, 5.0)) == 0).alias("allowed"),
        (fixed.lnprior([F.col("r_v")], (0.5, 2.0), (2.5, 5.0)) == 0).alias("allowed_fixed"),
    )


def _f99_sql() -> str:
    """The spline's second derivatives by elimination from both ends, in the query's own arithmetic."""
    anchors = [*models.F99_ANCHORS, 1e4 / 2700, 1e4 / 2600]
    n = len(anchors)
    h = [anchors[i + 1] - anchors[i] for i in range(n - 1)]
    uv = lambda x: f"(2.030 - 3.007 * (-0.824 + 4.717 / r) + (-0.824 + 4.717 / r) * {x} + 3.23 * {x} * {x} / (pow({x} * {x} - 4.596 * 4.596, 2) + pow({x} * 0.99, 2)) + CASE WHEN {x} > 5.9 THEN 0.41 * (0.5392 * pow({x} - 5.9, 2) + 0.05644 * pow({x} - 5.9, 3)) ELSE 0 END + r)"
    value = [f"({v!r}::DOUBLE * r / 3.1)" for v in models.F99_INFRARED]
    value += ["(" + " + ".join(f"({c!r}::DOUBLE) * pow(r, {i})" for i, c in enumerate(p)) + ")" for p in models.F99_OPTICAL]
    value += [uv(f"({x!r}::DOUBLE)") for x in anchors[-2:]]
    ctes = [f"y AS (SELECT *, {', '.join(f'{v} AS y{i}' for i, v in enumerate(value))} FROM w)"]
    before, pivot = "y", [0.0] * n
    for i in range(1, n - 1):  # forward elimination, one step a table
        above = h[i - 1] / pivot[i - 1] if i > 1 else 0.0
        pivot[i] = 2 * (h[i - 1] + h[i]) - above * (h[i - 1] if i > 1 else 0.0)
        right = f"6 * ((y{i + 1} - y{i}) / {h[i]!r}::DOUBLE - (y{i} - y{i - 1}) / {h[i - 1]!r}::DOUBLE)" + (f" - {above!r}::DOUBLE * d{i - 1}" if i > 1 else "")
        ctes.append(f"e{i} AS (SELECT *, {right} AS d{i} FROM {before})")
        before = f"e{i}"
    ctes.append(f"k{n - 1} AS (SELECT *, 0.0::DOUBLE AS k0, 0.0::DOUBLE AS k{n - 1} FROM {before})")
    for i in reversed(range(1, n - 1)):
        ctes.append(f"k{i}_ AS (SELECT *, (d{i} - {h[i]!r}::DOUBLE * k{i + 1}) / {pivot[i]!r}::DOUBLE AS k{i} FROM {f'k{n - 1}' if i == n - 2 else f'k{i + 1}_'})")
    cases = []
    for i in range(n - 2):
        a, b = f"({anchors[i + 1]!r}::DOUBLE - x)", f"(x - {anchors[i]!r}::DOUBLE)"
        cases.append(f"WHEN x < {anchors[i + 1]!r}::DOUBLE THEN (k{i} * pow({a}, 3) + k{i + 1} * pow({b}, 3)) / (6 * {h[i]!r}::DOUBLE) + (y{i} / {h[i]!r}::DOUBLE - k{i} * {h[i]!r}::DOUBLE / 6) * {a} + (y{i + 1} / {h[i]!r}::DOUBLE - k{i + 1} * {h[i]!r}::DOUBLE / 6) * {b}")
    u = [uniform_sql("c_custkey", i) for i in range(3)]
    return f"""
WITH w AS (SELECT c_custkey, 1 / pow(10, -0.9 + 1.9 * {u[0]}) AS x, 3.0 * {u[1]} AS a, 2.0 + 4.0 * {u[2]} AS r FROM customer), {', '.join(ctes)},
c AS (SELECT c_custkey, a, r, CASE {' '.join(cases)} ELSE {uv('x')} END / r AS c FROM k1_)
SELECT c_custkey, round(pow(10, -0.4 * a * c), 6) AS free, round(pow(10, -0.4 * c), 6) AS fixed, a BETWEEN 0.5 AND 2 AND r BETWEEN 2.5 AND 5 AS allowed, r BETWEEN 2.5 AND 5 AS allowed_fixed FROM c
"""


F99_EXTINCTION = _f99_sql()

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "mcmc_line_exact", "slice_line_exact", "lfi_line_exact", "nested_line_exact", "dynamic_nested_line_exact", "nested_two_modes", "draws_exact", "lnlike_corr_banded",
    "simulate_spectra", "resample_own", "prior_transform_noise", "prior_samples", "prior_positive_box", "chain_summary", "f99_extinction",
)}
