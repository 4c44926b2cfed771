"""Reductions of chains and weighted samples to diagnostics and posterior summaries.

A chain in long form has a group (any key columns), walker, step and value. Nothing
here brings a chain to one task but what is per group and parameter by definition.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from spectrail.functions import stats

PERCENTILES = (16.0, 50.0, 84.0)
RHAT_LIMIT = 1.05
GEWEKE_LIMIT = 2.0


def burn_in(chains: DataFrame, steps: int, step: str = "step") -> DataFrame:
    return chains.where(F.col(step) >= steps)


def credible_interval(df: DataFrame, keys: list[str], value: str, percentiles: tuple[float, float, float] = PERCENTILES) -> DataFrame:
    """Exact percentiles as the middle and the distances up and down; a key's distinct values fit one task's memory."""
    low, mid, high = (F.element_at("q", i) for i in (1, 2, 3))
    q = F.percentile(F.col(value), F.array(*[F.lit(p / 100) for p in percentiles]))
    return df.groupBy(*keys).agg(q.alias("q")).select(*keys, mid.alias("median"), (high - mid).alias("plus"), (mid - low).alias("minus"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], bins: int = 4096) -> DataFrame:
    """Quantiles with linear interpolation, as key, probability and quantile, for keys too large for one task's memory.

    A pass counts each key's values in equal bins; only the bins that hold a wanted rank are looked into, by
    counts of distinct values. Null and NaN values don't count.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.coalesce(F.least(F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)), F.lit(0))
    binned = rows.join(whole, keys).withColumn("_b", place)
    counts = binned.groupBy(*keys, "_n", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_s", F.sum("_c").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_c"))
    wanted = F.array(*[F.struct(F.lit(p).alias("probability"), (F.col("_n") - 1) * p) for p in probabilities])
    asked = before.select(*keys, "_n", "_b", "_c", "_s", F.explode(wanted).alias("w")).select(*keys, "_b", "_c", "_s", "w.probability", F.col("w.col2").alias("_h"))
    asked = asked.withColumn("_k", F.explode(F.array(F.floor("_h"), F.ceil("_h")))).where("_k >= _s AND _k < _s + _c")
    inside = binned.join(asked.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(W.partitionBy(*keys, "_b").orderBy("_v"))
    ranked = inside.select(*keys, "_b", "_v", upto.alias("_to"), (upto - F.col("_m")).alias("_from"))
    hit = asked.join(ranked, [*keys, "_b"]).where("_k - _s >= _from AND _k - _s < _to")
    low, high = F.min("_v"), F.max("_v")
    return hit.groupBy(*keys, "probability").agg((low + (F.first("_h") - F.floor(F.first("_h"))) * (high - low)).alias("quantile"))


def credible_interval_large(df: DataFrame, keys: list[str], value: str, percentiles: tuple[float, float, float] = PERCENTILES) -> DataFrame:
    """`credible_interval` by `exact_quantiles`."""
    low, mid, high = (p / 100 for p in percentiles)
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    return exact_quantiles(df, keys, value, [low, mid, high]).groupBy(*keys).agg(at(mid).alias("median"), (at(high) - at(mid)).alias("plus"), (at(mid) - at(low)).alias("minus"))


def map_point(df: DataFrame, keys: list[str], lnprob: str, order: list[str], carry: list[str]) -> DataFrame:
    """The row of greatest lnprob, NaN and null last; of equal ones the first by `order`."""
    # The greatest struct wins: ties fall to the smallest order through its negation.
    best = F.max_by(F.struct(*carry, *order), F.struct(stats.no_nan(F.col(lnprob)), *[-F.col(o) for o in order]))
    names = list(dict.fromkeys([*carry, *order]))
    return df.groupBy(*keys).agg(best.alias("b"), F.max(stats.no_nan(F.col(lnprob))).alias("lnprob")).select(*keys, *[F.col("b")[n].alias(n) for n in names], "lnprob")


def running(df: DataFrame, keys: list[str], order: list[str], amount: Column, upto: str, total: str, bins: int = 4096) -> DataFrame:
    """The sum of `amount` over each key's rows in `order` up to each row, and over all.

    Rows are summed within the first column of the order (a walker, say), or within equal bins of a number that is the
    only one, and moved on by the sums of those before, so that a key of any size is sorted by many tasks.
    """
    major, minor, rows = F.col(order[0]), order[1:], df
    if not minor:
        minor = order
        if isinstance(df.schema[order[0]].dataType, NumericType):
            ends = df.groupBy(*keys).agg(F.min(order[0]).cast("double").alias("_lo"), F.max(order[0]).cast("double").alias("_hi"))
            rows = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))
            place = F.floor(F.try_divide((major.cast("double") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
            major = F.coalesce(place, F.when(F.col(order[0]).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    part = [*keys, "_major"]
    rows = rows.withColumn("_major", major).withColumn("_amount", amount).drop("_lo", "_hi")
    sums = rows.groupBy(*part).agg(F.sum("_amount").alias("_c"))
    whole = W.partitionBy(*keys)
    starts = sums.select(*part, (F.sum("_c").over(whole.orderBy("_major")) - F.col("_c")).alias("_s"), F.sum("_c").over(whole).alias(total))
    own = F.sum("_amount").over(W.partitionBy(*part).orderBy(*minor).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(starts, part).select(*[F.col(c) for c in df.columns], (F.col("_s") + F.col("_own")).alias(upto), total)


def flat_ranks(df: DataFrame, keys: list[str], order: list[str], rank: str = "_r", total: str = "_n") -> DataFrame:
    """Each row's place among its key's rows in `order`, from 1, and their number."""
    return running(df, keys, order, F.lit(1).cast("long"), rank, total)


def _chunk(rank: Column, total: Column, chunks: int) -> Column:
    """The chunk of a rank, from 1; sizes differ by one at most and the first ones are the larger."""
    size, more = F.floor(total / chunks), total % chunks
    edge = (size + 1) * more
    return F.when(rank <= edge, F.ceil(rank / (size + 1))).otherwise(more + F.ceil((rank - edge) / F.greatest(size, F.lit(1)))).cast("int")


def _geweke(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    a, b = F.when(F.col("_a"), F.col(value)), F.when(F.col("_b"), F.col(value))
    sums = parts.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    z = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("va") + F.col("vb")))
    return sums.select(*keys, z.alias("z"), (F.abs(z) > GEWEKE_LIMIT).alias("warn"))


def geweke_flat(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """First against last quarter of the rows in `order` (walker-major order compares walkers); the last is rounded up."""
    parts = flat_ranks(df.select(*keys, value, *order), keys, order)
    return _geweke(parts.withColumn("_a", F.col("_r") <= F.floor(F.col("_n") / 4)).withColumn("_b", F.col("_r") > F.col("_n") - F.ceil(F.col("_n") / 4)), keys, value)


def geweke(df: DataFrame, keys: list[str], value: str, step: str) -> DataFrame:
    """First tenth against last half of the steps of each key, over all walkers."""
    rows = df.select(*keys, value, step)
    ends = rows.groupBy(*keys).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    place = F.try_divide((F.col(step) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo") + 1).cast("double"))
    # A row a key: no chain is gathered to find its ends.
    parts = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))
    return _geweke(parts.withColumn("_a", place < 0.1).withColumn("_b", place >= 0.5), keys, value)


def rhat_flat(df: DataFrame, parameter: str, value: str, order: list[str], splits: int = 2) -> DataFrame:
    """Split R-hat of flattened samples: within-variance averaged over splits and parameters, result averaged over parameters."""
    ranked = flat_ranks(df.select(parameter, value, *order), [parameter], order)
    by = ranked.select(parameter, value, _chunk(F.col("_r"), F.col("_n"), splits).alias("c")).groupBy(parameter, "c").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    per = by.groupBy(parameter).agg(F.max_by("n", "c").cast("double").alias("l"), (F.var_samp("m")).alias("bm"), F.avg("v").alias("wp"))
    within = per.agg(F.avg("wp").alias("w"))
    r = F.sqrt(((1 - 1 / F.col("l")) * F.col("w") + F.col("bm")) / F.col("w"))
    return per.crossJoin(F.broadcast(within)).agg(F.avg(r).alias("rhat"))


def rhat(df: DataFrame, keys: list[str], value: str, walker: str, step: str) -> DataFrame:
    """Split R-hat of each key: each walker's halves are chains."""
    half = F.ntile(2).over(W.partitionBy(*keys, walker).orderBy(step))
    by = df.select(*keys, walker, value, half.alias("h")).groupBy(*keys, walker, "h").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    n, w, b = F.avg("n"), F.avg("v"), F.var_samp("m")
    return by.groupBy(*keys).agg(F.sqrt(F.try_divide((n - 1) / n * w + b, w)).alias("rhat"))


def autocorrelation(df: DataFrame, keys: list[str], value: str, order: list[str], lags: int) -> DataFrame:
    """rho at lags 0 to `lags` of each key's series: one sort per key, no self-join."""
    w = W.partitionBy(*keys)
    centred = df.select(*keys, *order, (F.col(value) - F.avg(value).over(w)).alias("_d"))
    shifted = [(F.col("_d") * F.lag("_d", k).over(w.orderBy(*order))).alias(f"_{k}") for k in range(lags + 1)]
    sums = centred.select(*keys, *shifted).groupBy(*keys).agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in range(lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(F.col(f"_{k}"), F.lit(0.0)), F.col("_0")).alias("rho")) for k in range(lags + 1)])
    return sums.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.lag", "p.rho")


def walker_autocorrelation(x: np.ndarray) -> np.ndarray:
    """rho of one walker's series at all lags by FFT; NaN for a constant one."""
    n = len(x)
    f = np.fft.rfft(x - x.mean(), 1 << (2 * n - 1).bit_length())
    acf = np.fft.irfft(f * np.conj(f), 1 << (2 * n - 1).bit_length())[:n]
    with np.errstate(invalid="ignore", divide="ignore"):
        return acf / acf[0]


def integrated_time(rho: np.ndarray, window: float = 5.0) -> float:
    """Autocorrelation time of a mean rho, summed up to the first lag above `window` times the sum."""
    tau = 2 * np.cumsum(rho) - 1
    past = np.flatnonzero(np.arange(len(rho)) >= window * tau)
    return float(tau[past[0]] if len(past) else tau[-1]) if len(rho) else float("nan")


def autocorrelation_time(df: DataFrame, keys: list[str], value: str, walker: str, step: str) -> DataFrame:
    """tau per key from the mean autocorrelation of its walkers, as far as the shortest of them goes.

    A walker's series is one task's group; only the means by lag come together for a key.
    """

    def by_lag(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = walker_autocorrelation(pdf.sort_values(step)[value].to_numpy(dtype=float))
        return pd.concat([pdf[keys].head(1)] * len(rho), ignore_index=True).assign(lag=np.arange(len(rho)), rho=rho, n=len(rho)) if len(rho) else pdf[keys].head(0).assign(lag=[], rho=[], n=[])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].head(1).assign(tau=integrated_time(pdf.sort_values("lag")["rho"].to_numpy()))

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    once = df.select(*keys, walker, step, value).dropDuplicates([*keys, walker, step])
    walkers = once.groupBy(*keys, walker).applyInPandas(by_lag, f"{kinds}, lag long, rho double, n long")
    means = walkers.groupBy(*keys, "lag").agg(F.avg(F.nanvl("rho", F.lit(None).cast("double"))).alias("rho"), F.count(F.lit(1)).alias("walkers"))
    whole = walkers.where("lag = 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("walkers"))
    return means.join(whole, [*keys, "walkers"]).select(*keys, "lag", "rho").groupBy(*keys).applyInPandas(summed, f"{kinds}, tau double")


def effective_samples(walkers: float, steps: float, tau: float) -> float:
    return walkers * steps / tau


def acceptance(df: DataFrame, keys: list[str], accepted: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(accepted).cast("double")).alias("acceptance"))


def weighted_moments(df: DataFrame, keys: list[str], weight: str, values: list[str]) -> DataFrame:
    """Weighted means and covariances of values; one pass of sums about the mean of each key."""
    means = df.groupBy(*keys).agg(F.sum(weight).alias("_w"), *[(F.sum(F.col(weight) * F.col(v)) / F.sum(weight)).alias(f"mean_{v}") for v in values])
    d = {v: F.col(v) - F.col(f"mean_{v}") for v in values}
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i:]]
    sums = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))
    covs = [(F.sum(F.col(weight) * d[a] * d[b]) / F.sum(weight)).alias(f"cov_{a}_{b}") for a, b in pairs]
    return sums.groupBy(*keys, *[f"mean_{v}" for v in values]).agg(*covs)


def evidence(df: DataFrame, keys: list[str], logwt: str) -> DataFrame:
    """ln Z as log-sum-exp of log weights."""
    top = df.groupBy(*keys).agg(F.max(logwt).alias("_top"))
    return df.join(top, keys).groupBy(*keys).agg(stats.log_sum_exp(F.col(logwt), F.col("_top")).alias("logz"))


def nested_summary(df: DataFrame, keys: list[str], logwt: str, logl: str, live: int) -> DataFrame:
    """Of a nested run ln Z, its error, the information in nats and the effective number of samples."""
    joined = df.join(evidence(df, keys, logwt), keys)
    p = F.exp(F.col(logwt) - F.col("logz"))
    sums = joined.groupBy(*keys, "logz").agg(F.sum(p * (F.col(logl) - F.col("logz"))).alias("information"), (F.pow(F.sum(p), F.lit(2.0)) / F.sum(p * p)).alias("effective"))
    return sums.withColumn("logz_error", F.sqrt(F.greatest("information", F.lit(0.0)) / live))


def last_sample(df: DataFrame, keys: list[str], iteration: str, carry: list[str]) -> DataFrame:
    """The maximum-likelihood point of nested sampling: the last dead or live point."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*carry), iteration).alias("b")).select(*keys, *[F.col("b")[c].alias(c) for c in carry])


def systematic_resample(df: DataFrame, keys: list[str], weight: str, order: list[str], draws: int, offset: Column) -> DataFrame:
    """Equal-weight draws: a sample is repeated once for each point (k + offset) / draws inside its stretch of cumulated weight.

    The number of points in a stretch is a difference of two floors: no range join is needed.
    """
    summed = running(df, keys, order, F.col(weight), "_upto", "_all")
    cum = F.col("_upto") / F.col("_all") * draws
    prev = (F.col("_upto") - F.col(weight)) / F.col("_all") * draws
    hit = lambda c: F.least(F.greatest(F.ceil(c - offset), F.lit(0)), F.lit(draws))
    counted = summed.withColumn("_from", hit(prev)).withColumn("_to", hit(cum))
    return counted.where("_to > _from").withColumn("draw", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))).select(*df.columns, "draw")


def draw_rows(df: DataFrame, keys: list[str], order: list[str], draws: int, seed: int) -> DataFrame:
    """Rows drawn with replacement: keyed uniforms name row numbers, an equi-join fetches them."""
    numbered = flat_ranks(df, keys, order).drop("_n")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.floor(stats.keyed_uniform(F.lit(seed), *[F.col(k) for k in keys], F.col("draw")) * F.col("_n")) + 1
    wanted = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_r", pick.cast("long")).drop("_n")
    return wanted.join(numbered, [*keys, "_r"]).drop("_r")


def histogram(df: DataFrame, keys: list[str], axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Counts in equal bins of one or more columns; bins count from 1, what lies outside goes to 0 and n + 1."""
    bins = [F.width_bucket(F.col(c), F.lit(lo), F.lit(hi), F.lit(n)).alias(f"{c}_bin") for c, (lo, hi, n) in axes.items()]
    return df.select(*keys, *bins).groupBy(*keys, *[f"{c}_bin" for c in axes]).agg(F.count(F.lit(1)).alias("n"))


def envelope(df: DataFrame, keys: list[str], x: str, y: str, log: bool = False) -> DataFrame:
    """Axis limits: 0.8 and 1.2 of the extremes, or 0.5 and 2 with a floor of 1e-5 of the greatest y in logarithms."""
    low, high = (0.5, 2.0) if log else (0.8, 1.2)
    ymin = F.greatest(F.min(y), 1e-5 * F.max(y)) if log else F.min(y)
    return df.groupBy(*keys).agg((low * F.min(x)).alias("x_min"), (high * F.max(x)).alias("x_max"), (low * ymin).alias("y_min"), (high * F.max(y)).alias("y_max"))


def predictive_band(df: DataFrame, keys: list[str], value: str, percentiles: tuple[float, float, float] = PERCENTILES) -> DataFrame:
    """Percentiles of model curves at each grid point."""
    q = F.percentile(F.col(value), F.array(*[F.lit(p / 100) for p in percentiles]))
    return df.groupBy(*keys).agg(q.alias("q")).select(*keys, *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("low", "middle", "high"))])


def summary(chains: DataFrame, labels: list[str], walkers: int, steps: int) -> DataFrame:
    """(statistic, parameter, value) of a run: chains has walker, step, theta, lnprob, accepted."""
    named = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col("theta")[i].alias("value")) for i, n in enumerate(labels)])
    long = chains.select("walker", "step", F.explode(named).alias("p")).select("walker", "step", "p.parameter", "p.value")
    rows = lambda df, cols: df.select("parameter", F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in cols])).alias("s")).select("s.statistic", "parameter", "s.value")
    tau = autocorrelation_time(long, ["parameter"], "value", "walker", "step")
    out = rows(credible_interval(long, ["parameter"], "value"), ["median", "plus", "minus"])
    out = out.unionByName(rows(geweke(long, ["parameter"], "value", "step"), ["z"])).unionByName(rows(rhat(long, ["parameter"], "value", "walker", "step"), ["rhat"])).unionByName(rows(tau, ["tau"]))
    ess = tau.agg(F.lit("ess").alias("statistic"), F.lit(None).cast("string").alias("parameter"), (F.lit(float(walkers * steps)) / F.avg("tau")).alias("value"))
    rate = chains.agg(F.lit("acceptance").alias("statistic"), F.lit(None).cast("string").alias("parameter"), F.avg(F.col("accepted").cast("double")).alias("value"))
    best = chains.agg(F.max_by("theta", F.struct(stats.no_nan(F.col("lnprob")), -F.col("walker"), -F.col("step"))).alias("theta"))
    best = best.select(F.explode(named).alias("p")).select(F.lit("map").alias("statistic"), "p.parameter", "p.value")
    return out.unionByName(ess).unionByName(rate).unionByName(best)


def write_report(summary: DataFrame, path: str) -> None:
    """A summary as lines of text: a line for each parameter, then what concerns the whole run, as one file: a summary has a few rows a parameter."""
    value = F.format_string("%.6g", F.col("value"))
    lines = summary.groupBy("parameter").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" = ", "statistic", value))), ", ").alias("text"))
    named = lines.select(F.col("parameter").isNull().alias("last"), F.coalesce("parameter", F.lit("run")).alias("name"), "text")
    named.coalesce(1).sortWithinPartitions("last", "name").select(F.concat_ws(": ", "name", "text").alias("value")).write.mode("overwrite").text(path)


def log10_safe(x: Column) -> Column:
    return F.when(x > 0, F.log10(F.when(x > 0, x))).otherwise(F.lit(-math.inf))
