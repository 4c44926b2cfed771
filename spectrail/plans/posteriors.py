"""Queries on chains and weighted samples, with their SQL twins, and samplers without one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.operators import diagnostics, noise, samplers
from spectrail.plans.inputs import CHAINS_SQL, SPECTRA_SQL, chains, spectra, table, uniform, uniform_sql


def credible_interval(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.credible_interval(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "plus", "minus")])


CREDIBLE_INTERVAL = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.16) AS l, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.84) AS h FROM events GROUP BY 1)
SELECT event_type, round(m, 6) AS median, round(h - m, 6) AS plus, round(m - l, 6) AS minus FROM q
"""


def credible_interval_large(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.credible_interval_large(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "plus", "minus")])


CREDIBLE_INTERVAL_LARGE = CREDIBLE_INTERVAL


def map_point(spark: SparkSession, sf: str) -> DataFrame:
    rows = chains(spark, sf).withColumn("lnprob", -F.abs(F.round("value") - 250))
    out = diagnostics.map_point(rows, ["event_type"], "lnprob", ["user_id", "step"], ["value"])
    return out.select("event_type", "value", "user_id", F.col("step").cast("long").alias("step"), "lnprob")


MAP_POINT = f"""
WITH {CHAINS_SQL}, l AS (SELECT *, -abs(round(value) - 250) AS lnprob FROM c)
SELECT event_type, value, user_id, step, lnprob FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY lnprob DESC, user_id, step) = 1
"""


def geweke_flat(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.geweke_flat(chains(spark, sf), ["event_type"], "value", ["user_id", "step"])
    return out.select("event_type", F.round("z", 6).alias("z"), "warn")


GEWEKE_FLAT = f"""
WITH {CHAINS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id, step) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM c),
s AS (SELECT event_type, avg(value) FILTER (r <= n // 4) AS ma, avg(value) FILTER (r > n - ceil(n / 4)) AS mb, var_pop(value) FILTER (r <= n // 4) AS va, var_pop(value) FILTER (r > n - ceil(n / 4)) AS vb FROM r GROUP BY 1)
SELECT event_type, round((ma - mb) / sqrt(va + vb), 6) AS z, abs((ma - mb) / sqrt(va + vb)) > 2 AS warn FROM s
"""


def geweke_steps(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.geweke(chains(spark, sf), ["event_type"], "value", "step")
    return out.select("event_type", F.round("z", 6).alias("z"), "warn")


GEWEKE_STEPS = f"""
WITH {CHAINS_SQL}, b AS (SELECT event_type, min(step) AS lo, max(step) AS hi FROM c GROUP BY 1), r AS (SELECT c.*, (step - lo)::DOUBLE / (hi - lo + 1) AS p FROM c JOIN b USING (event_type)),
s AS (SELECT event_type, avg(value) FILTER (p < 0.1) AS ma, avg(value) FILTER (p >= 0.5) AS mb, var_pop(value) FILTER (p < 0.1) AS va, var_pop(value) FILTER (p >= 0.5) AS vb FROM r GROUP BY 1)
SELECT event_type, round((ma - mb) / sqrt(va + vb), 6) AS z, abs((ma - mb) / sqrt(va + vb)) > 2 AS warn FROM s
"""


def rhat_flat(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.rhat_flat(chains(spark, sf), "event_type", "value", ["user_id", "step"]).select(F.round("rhat", 6).alias("rhat"))


RHAT_FLAT = f"""
WITH {CHAINS_SQL}, t AS (SELECT event_type, value, ntile(2) OVER (PARTITION BY event_type ORDER BY user_id, step) AS k FROM c),
b AS (SELECT event_type, k, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM t GROUP BY ALL),
p AS (SELECT event_type, arg_max(n, k)::DOUBLE AS l, var_samp(m) AS b, avg(v) AS w FROM b GROUP BY 1)
SELECT round(avg(sqrt(((1 - 1 / l) * (SELECT avg(w) FROM p) + b) / (SELECT avg(w) FROM p))), 6) AS rhat FROM p
"""


def rhat_split(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.rhat(chains(spark, sf), ["event_type"], "value", "user_id", "step").select("event_type", F.round("rhat", 6).alias("rhat"))


RHAT_SPLIT = f"""
WITH {CHAINS_SQL}, t AS (SELECT event_type, user_id, value, ntile(2) OVER (PARTITION BY event_type, user_id ORDER BY step) AS h FROM c),
b AS (SELECT event_type, user_id, h, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM t GROUP BY ALL)
SELECT event_type, round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS rhat FROM b GROUP BY 1
"""


def autocorr_lags(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.autocorrelation(table(spark, sf, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], "value", ["ts", "event_id"], 10)
    return out.select("event_type", F.col("lag").cast("long").alias("lag"), F.round("rho", 6).alias("rho"))


AUTOCORR_LAGS = """
WITH d AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT a.event_type, l.k AS lag, sum(a.d * b.d) AS s FROM range(11) l(k), d a JOIN d b ON b.event_type = a.event_type AND b.i = a.i - l.k GROUP BY ALL)
SELECT event_type, lag, round(s / first_value(s) OVER (PARTITION BY event_type ORDER BY lag), 6) AS rho FROM p
"""


def ess(spark: SparkSession, sf: str) -> DataFrame:
    """Effective samples from autocorrelations summed to lag ten."""
    rho = diagnostics.autocorrelation(table(spark, sf, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], "value", ["ts", "event_id"], 10)
    tau = rho.groupBy("event_type").agg((2 * F.sum("rho") - 1).alias("tau"))
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return tau.join(n, "event_type").select("event_type", F.round("tau", 6).alias("tau"), F.round(diagnostics.effective_samples(F.lit(1.0), F.col("n"), F.col("tau")), 4).alias("ess"))


ESS = f"""
WITH r AS ({AUTOCORR_LAGS.replace('round(s / first_value(s) OVER (PARTITION BY event_type ORDER BY lag), 6)', 's / first_value(s) OVER (PARTITION BY event_type ORDER BY lag)')}),
t AS (SELECT event_type, 2 * sum(rho) - 1 AS tau FROM r GROUP BY 1)
SELECT event_type, round(tau, 6) AS tau, round(n / tau, 4) AS ess FROM t JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)
"""


def acceptance(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.acceptance(table(spark, sf, "events").withColumn("accepted", F.col("value") > 100), ["event_type"], "accepted")
    return out.select("event_type", F.round("acceptance", 8).alias("acceptance"))


ACCEPTANCE = "SELECT event_type, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS acceptance FROM events GROUP BY 1"


def weighted_mean_cov(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    out = diagnostics.weighted_moments(rows, ["l_returnflag"], "l_quantity", ["l_discount", "l_tax"])
    return out.select("l_returnflag", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


WEIGHTED_MEAN_COV = """
WITH m AS (SELECT l_returnflag, sum(l_quantity * l_discount) / sum(l_quantity) AS a, sum(l_quantity * l_tax) / sum(l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a, 9) AS mean_l_discount, round(b, 9) AS mean_l_tax, round(sum(l_quantity * (l_discount - a) * (l_discount - a)) / sum(l_quantity), 9) AS cov_l_discount_l_discount,
  round(sum(l_quantity * (l_discount - a) * (l_tax - b)) / sum(l_quantity), 9) AS cov_l_discount_l_tax, round(sum(l_quantity * (l_tax - b) * (l_tax - b)) / sum(l_quantity), 9) AS cov_l_tax_l_tax
FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag, a, b
"""


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    out = diagnostics.evidence(table(spark, sf, "events").withColumn("logwt", F.col("value") / 10 - 1000), ["event_type"], "logwt")
    return out.select("event_type", F.round("logz", 8).alias("logz"))


EVIDENCE = """
WITH m AS (SELECT event_type, max(value / 10 - 1000) AS m FROM events GROUP BY 1)
SELECT event_type, round(m + ln(sum(exp(value / 10 - 1000 - m))), 8) AS logz FROM events JOIN m USING (event_type) GROUP BY event_type, m
"""


def last_sample(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.last_sample(table(spark, sf, "events"), ["event_type"], "event_id", ["event_id", "value"])


LAST_SAMPLE = "SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1"


def systematic_resample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", "event_id", F.floor("value").alias("w"))
    drawn = diagnostics.systematic_resample(rows, ["event_type"], "w", ["event_id"], 200, F.lit(0.37))
    return drawn.groupBy("event_type", "event_id").agg(F.count(F.lit(1)).alias("n"))


SYSTEMATIC_RESAMPLE = """
WITH w AS (SELECT event_type, event_id, CAST(floor(value) AS BIGINT) AS w FROM events), t AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY event_id) AS c, sum(w) OVER (PARTITION BY event_type) AS a FROM w),
p AS (SELECT event_type, event_id, (c - w)::DOUBLE / a * 200 AS lo, c::DOUBLE / a * 200 AS hi FROM t)
SELECT event_type, event_id, count(*) AS n FROM p JOIN range(200) r(k) ON k + 0.37 >= lo AND k + 0.37 < hi GROUP BY ALL
"""


def burnin_flatten(spark: SparkSession, sf: str) -> DataFrame:
    kept = diagnostics.burn_in(chains(spark, sf), 4)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


BURNIN_FLATTEN = f"WITH {CHAINS_SQL} SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM c WHERE step >= 4 GROUP BY 1"


def corner_hist(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_discount", (F.col("l_quantity") + 0.5).alias("l_quantity"))
    one = diagnostics.histogram(rows, [], {"l_quantity": (0.0, 50.0, 20)}).select(F.col("l_quantity_bin"), F.lit(-1).cast("long").alias("l_discount_bin"), "n")
    two = diagnostics.histogram(rows.withColumn("l_discount", F.col("l_discount") + 0.005), [], {"l_quantity": (0.0, 50.0, 20), "l_discount": (0.0, 0.1, 5)})
    return one.unionByName(two)


CORNER_HIST = """
WITH b AS (SELECT CASE WHEN q < 0 THEN 0 WHEN q >= 50 THEN 21 ELSE CAST(floor(q / 2.5) AS BIGINT) + 1 END AS l_quantity_bin, CASE WHEN d >= 0.1 THEN 6 ELSE CAST(floor(d * 5 / 0.1) AS BIGINT) + 1 END AS l_discount_bin
  FROM (SELECT l_quantity + 0.5 AS q, l_discount + 0.005::DOUBLE AS d FROM lineitem))
SELECT l_quantity_bin, -1::BIGINT AS l_discount_bin, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT l_quantity_bin, l_discount_bin, count(*) FROM b GROUP BY ALL
"""


def envelope(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    one = diagnostics.envelope(rows, ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("scale", F.lit("linear"))
    two = diagnostics.envelope(rows, ["l_returnflag"], "l_quantity", "l_extendedprice", log=True).withColumn("scale", F.lit("log"))
    both = one.unionByName(two)
    return both.select("l_returnflag", "scale", *[F.round(c, 4).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


ENVELOPE = """
SELECT l_returnflag, 'linear' AS scale, round(0.8 * min(l_quantity), 4) AS x_min, round(1.2 * max(l_quantity), 4) AS x_max, round(0.8 * min(l_extendedprice), 4) AS y_min, round(1.2 * max(l_extendedprice), 4) AS y_max FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'log', round(0.5 * min(l_quantity), 4), round(2.0 * max(l_quantity), 4), round(0.5 * greatest(min(l_extendedprice), 1e-5 * max(l_extendedprice)), 4), round(2.0 * max(l_extendedprice), 4) FROM lineitem GROUP BY 1
"""


def predictive_band(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile bands over spectra drawn with replacement by keyed uniforms."""
    sizes = table(spark, sf, "embeddings").select("label", "vec_id")
    # The draw's row number: as in the twin, from a uniform that SQL computes alike.
    n = sizes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wanted = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("r", (F.floor(uniform(F.col("label"), F.col("draw")) * F.col("n")) + 1).cast("int"))
    numbered = sizes.withColumn("r", F.row_number().over(diagnostics.W.partitionBy("label").orderBy("vec_id")))
    curves = wanted.join(numbered, ["label", "r"]).select("label", "vec_id").join(spectra(spark, sf), "vec_id")
    out = diagnostics.predictive_band(curves, ["label", "k"], "y")
    return out.select("label", "k", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


PREDICTIVE_BAND = f"""
WITH {SPECTRA_SQL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT label, CAST(floor({uniform_sql('label', 'd')} * n) AS BIGINT) + 1 AS r FROM n, range(50) q(d)),
i AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), c AS (SELECT label, k, y FROM w JOIN i USING (label, r) JOIN s USING (vec_id))
SELECT label, k, round(quantile_cont(y, 0.16), 6) AS low, round(quantile_cont(y, 0.5), 6) AS middle, round(quantile_cont(y, 0.84), 6) AS high FROM c GROUP BY ALL
"""


def draws_with_replacement(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.draw_rows(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], 100, 7)


def lnlike_corr_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated likelihoods of every spectrum against its class's first one, with three sets of noise parameters."""
    vectors = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("flux"))
    data = vectors.groupBy(F.col("label").alias("class")).agg(F.min_by("flux", "vec_id").alias("data"))
    n = len(vectors.select("flux").first()["flux"])
    # The data differ by class, so that they are taken off the fluxes: scale * data - flux is what is left of zero.
    spectrum = noise.Spectrum(np.arange(n, dtype=float), np.zeros(n), np.full(n, 0.5))
    pairs = vectors.join(data, F.col("label").eqNullSafe(F.col("class")))
    params = pairs.withColumn("noise", F.explode(F.array(*[F.array(*map(F.lit, t)) for t in ((1.0, 0.0, 1.0), (1.0, 0.2, 2.0), (0.98, 0.5, 4.0))])))
    params = params.withColumn("flux", F.zip_with("flux", "data", lambda f, d: f - F.col("noise")[0] * d))
    return noise.lnlike_correlated(params, spectrum).select("vec_id", "noise", "lnlike")


LINE_X = np.arange(8, 48, dtype=float)
LINE_SD = 0.125


def _line_problem(pdf: pd.DataFrame) -> samplers.Problem:
    y = np.array(pdf["y"].iloc[0])
    like = lambda t: -0.5 * (((t[:, :1] * LINE_X + t[:, 1:2] - y) / LINE_SD) ** 2).sum(axis=1) - len(y) * (np.log(LINE_SD) + 0.5 * np.log(2 * np.pi))
    inside = lambda t: (np.abs(t) < 5).all(axis=1)
    return samplers.Problem(lambda t: np.where(inside(t), like(t), -np.inf), 2, np.array([0.0, 0.1]), None, like, lambda u: -5 + 10 * u)


def _line_objects(spark: SparkSession, sf: str) -> DataFrame:
    """One mean spectrum for each label: ten objects."""
    mean = spectra(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").where("k BETWEEN 8 AND 47").groupBy("label", "k").agg(F.avg("y").alias("y"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda r: r["y"]).alias("y"))


def _chain_summary(out: DataFrame) -> DataFrame:
    return out.groupBy("label").agg(F.avg(F.col("theta")[0]).alias("slope"), F.avg(F.col("theta")[1]).alias("intercept"), F.stddev_samp(F.col("theta")[0]).alias("slope_sd"), F.count(F.lit(1)).alias("n"))


def mcmc_line(spark: SparkSession, sf: str) -> DataFrame:
    sampler = samplers.EnsembleMCMC(24, 400, 200, (("stretch", 0.4), ("de", 0.5), ("snooker", 0.1)))
    return _chain_summary(samplers.run_chains(_line_objects(spark, sf), ["label"], _line_problem, sampler, chains=2, seed=11))


def slice_line(spark: SparkSession, sf: str) -> DataFrame:
    return _chain_summary(samplers.run_chains(_line_objects(spark, sf), ["label"], _line_problem, samplers.EnsembleSlice(24, 200, 100), seed=12))


def nested_line(spark: SparkSession, sf: str) -> DataFrame:
    out = samplers.run_nested(_line_objects(spark, sf), ["label"], _line_problem, samplers.NestedSampler(100, 0.1), seed=13)
    last = diagnostics.evidence(out, ["label"], "logwt")
    weighted = out.drop("logz").join(last, "label").withColumn("w", F.exp(F.col("logwt") - F.col("logz"))).withColumn("slope", F.col("theta")[0]).withColumn("intercept", F.col("theta")[1])
    return diagnostics.weighted_moments(weighted, ["label"], "w", ["slope", "intercept"]).join(last, "label")


def lfi_line(spark: SparkSession, sf: str) -> DataFrame:
    """Simulations in two rounds and a Gaussian regression, one object a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, rng = np.array(pdf["y"].iloc[0]), samplers.seed_of(14, int(pdf["label"].iloc[0]))
        draws = samplers.SequentialPosterior(1000, 2, 2000).run(
            lambda n, r: r.uniform(-5, 5, (n, 2)), lambda t: (np.abs(t) < 5).all(axis=1),
            lambda t, r: t[:, :1] * LINE_X + t[:, 1:2] + LINE_SD * r.standard_normal((len(t), len(LINE_X))), y, rng)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "slope": [draws[:, 0].mean()], "intercept": [draws[:, 1].mean()], "slope_sd": [draws[:, 0].std()], "n": [len(draws)]})

    return _line_objects(spark, sf).groupBy("label").applyInPandas(run, "label int, slope double, intercept double, slope_sd double, n long")


QUERIES = {name: (globals()[name], globals().get(name.upper())) for name in (
    "credible_interval", "credible_interval_large", "map_point", "geweke_flat", "geweke_steps", "rhat_flat", "rhat_split", "autocorr_lags", "ess", "acceptance", "weighted_mean_cov", "evidence", "last_sample",
    "systematic_resample", "burnin_flatten", "corner_hist", "envelope", "predictive_band", "draws_with_replacement", "lnlike_corr_dense", "mcmc_line", "slice_line", "nested_line", "lfi_line",
)}
