"""From one grid to another: interpolation, clamping, extrapolation, flux-conserving bins.

Long tables are interpolated by one sort per key: samples and targets are put in one
table and each target looks back and forward to the nearest samples, so that no range
join is planned. Rebinning joins source cells and target bins that overlap through
buckets of the axis, an equi-join. Arrays are interpolated in Arrow batches by np.interp.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTSIDE = ("clamp", "null", "error", "extrapolate")


def interpolate(samples: DataFrame, targets: DataFrame, keys: list[str], x: str, y: str, outside: str = "clamp", log_x: bool = False, log_y: bool = False) -> DataFrame:
    """Each target with y interpolated between the key's neighbouring samples.

    outside: what a target beyond the samples gets. log_x and log_y interpolate in logarithms.
    Repeated x of samples: the last by y counts for targets above, the first for those below.
    """
    if outside not in OUTSIDE:
        raise ValueError(f"outside is one of {OUTSIDE}, not {outside!r}")
    fx: Callable[[Column], Column] = F.log10 if log_x else lambda c: c
    fy: Callable[[Column], Column] = F.log10 if log_y else lambda c: c
    # A column of the input with a like name isn't touched: extra columns travel in a struct.
    extra = [c for c in targets.columns if c not in (*keys, x)]
    point = F.struct(fx(F.col(x)).alias("x"), fy(F.col(y)).alias("y"))
    none = F.lit(None)
    known = samples.select(*keys, F.col(x).alias("_x"), F.lit(0).alias("_kind"), F.col(y).alias("_y"), point.alias("_p"))
    asked = targets.select(*keys, F.col(x).alias("_x"), F.lit(1).alias("_kind"), none.cast("double").alias("_y"), F.struct(F.lit(1).alias("_"), *extra).alias("_rest"))
    both = known.withColumn("_rest", none.cast(asked.schema["_rest"].dataType)).unionByName(asked.withColumn("_p", none.cast(known.schema["_p"].dataType)))
    up = W.partitionBy(*keys).orderBy("_x", "_kind", "_y")
    before, after = up.rowsBetween(W.unboundedPreceding, 0), up.rowsBetween(1, W.unboundedFollowing)
    held = both.withColumn("_lo", F.last("_p", True).over(before)).withColumn("_hi", F.first("_p", True).over(after))
    if outside == "extrapolate":
        # The two samples before the first and behind the last bracket are that bracket itself.
        nth = lambda f, n: F.nth_value("_p", n, True).over(f)
        down = W.partitionBy(*keys).orderBy(F.col("_x").desc(), F.col("_kind").desc(), F.col("_y").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        all_up = up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        held = held.withColumn("_l2", nth(down, 2)).withColumn("_r2", nth(all_up, 2)).withColumn("_lo2", F.when(F.col("_lo").isNull(), F.col("_hi")).when(F.col("_hi").isNull(), F.col("_l2")).otherwise(F.col("_lo")))
        held = held.withColumn("_hi2", F.when(F.col("_lo").isNull(), F.col("_r2")).when(F.col("_hi").isNull(), F.col("_lo")).otherwise(F.col("_hi")))
        lo, hi = F.col("_lo2"), F.col("_hi2")
    else:
        lo, hi = F.col("_lo"), F.col("_hi")
    at = fx(F.col("_x"))
    line = F.when(at == lo["x"], lo["y"]).otherwise(lo["y"] + (at - lo["x"]) * F.try_divide(hi["y"] - lo["y"], hi["x"] - lo["x"]))
    if outside == "clamp":
        value = F.coalesce(line, lo["y"], hi["y"])
    elif outside == "error":
        beyond = lo.isNull() | (hi.isNull() & (at != lo["x"]))
        value = F.when(beyond, F.raise_error(F.concat(F.lit("no sample beside "), F.col("_x").cast("string"))).cast("double")).otherwise(line)
    else:
        value = line
    if log_y:
        value = F.pow(F.lit(10.0), value)
    return held.where("_kind = 1").select(*keys, F.col("_x").alias(x), *[F.col("_rest")[c].alias(c) for c in extra], value.alias(y))


def rayleigh_jeans_patch(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Null y behind the last known sample continues as x to the power -2."""
    before = W.partitionBy(*keys).orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col(y).isNotNull(), F.struct(x, y)), True).over(before)
    return df.withColumn("_l", last).withColumn(y, F.coalesce(F.col(y), F.col("_l")[y] * F.pow(F.col(x) / F.col("_l")[x], F.lit(-2.0)))).drop("_l")


def cell_edges(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Edges halfway between neighbours; the first and last cell are symmetric about their points."""
    w = W.partitionBy(*keys).orderBy(x)
    here, left, right = F.col(x), F.lag(x).over(w), F.lead(x).over(w)
    lo = F.coalesce((left + here) / 2, here - (right - here) / 2)
    hi = F.coalesce((here + right) / 2, here + (here - left) / 2)
    return df.withColumn("lo", lo).withColumn("hi", hi)


def rebin(source: DataFrame, bins: DataFrame, keys: list[str], x: str, y: str, bucket: float, fill: float | None = None) -> DataFrame:
    """Overlap-weighted means of the source cells in each bin (same keys, columns x).

    bucket: width of the axis buckets through which cells and bins meet; about the wider of the two
    is right. Bins that the source doesn't cover at all get `fill`.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    s = spread(cell_edges(source.select(*keys, x, y), keys, x)).select(*keys, "_b", F.col("lo").alias("_slo"), F.col("hi").alias("_shi"), F.col(y).alias("_f"))
    edged = cell_edges(bins.select(*keys, x), keys, x)
    b = spread(edged).select(*keys, "_b", F.col(x).alias("_x"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    # A pair that shares several buckets counts in the first one only.
    first = F.floor(F.greatest("_slo", "_lo") / bucket) == F.col("_b")
    width = F.least("_shi", "_hi") - F.greatest("_slo", "_lo")
    met = b.join(s, [*keys, "_b"]).where(first & (width > 0)).groupBy(*keys, F.col("_x").alias(x)).agg((F.sum(F.col("_f") * width) / F.sum(width)).alias(y))
    return edged.select(*keys, x).join(met, [*keys, x], "left").withColumn(y, F.coalesce(F.col(y), F.lit(fill).cast("double")))


def rebin_np(new_x: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for one spectrum (or rows of y) in NumPy, NaN where nothing overlaps; exact through the running integral."""

    def edges(g: np.ndarray) -> np.ndarray:
        middle = (g[1:] + g[:-1]) / 2
        return np.concatenate([[g[0] - (g[1] - g[0]) / 2], middle, [g[-1] + (g[-1] - g[-2]) / 2]])

    e, n = edges(x), edges(new_x)
    total = np.concatenate([np.zeros((*y.shape[:-1], 1)), np.cumsum(y * np.diff(e), axis=-1)], axis=-1)
    inside = np.clip(n, e[0], e[-1])
    at = np.clip(np.searchsorted(e, inside, side="right") - 1, 0, len(x) - 1)
    integral = total[..., at] + y[..., at] * (inside - e[at])
    width = np.diff(inside)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(width > 0, np.diff(integral, axis=-1) / width, np.nan)


RESAMPLERS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    "fast": lambda new_x, x, y: np.interp(new_x, x, y),
    "exact": rebin_np,
}


def resample_arrays(df: DataFrame, x: str, y: str, new_x: str, out: str, method: str | Callable = "fast") -> DataFrame:
    """Resample array columns row by row in Arrow batches; `method` is a name or a function f(new_x, x, y)."""
    f = RESAMPLERS[method] if isinstance(method, str) else method

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in r) else f(*r) for r in zip(c, a, b, strict=True)])

    return df.withColumn(out, run(x, y, new_x))


def tail(df: DataFrame, keys: list[str], x: str, y: str, reach: float, points: int, power: float = -4.0) -> DataFrame:
    """The table with points spaced evenly in log x from each key's last sample to `reach`, falling as a power of x."""
    last = df.groupBy(*keys).agg(F.max(F.struct(x, y)).alias("l"))
    step = (F.log10(F.lit(float(reach))) - F.log10(F.col("l")[x])) / points
    grown = last.select(*keys, "l", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("i"), step.alias("s"))
    new_x = F.pow(F.lit(10.0), F.log10(F.col("l")[x]) + F.col("i") * F.col("s"))
    return df.select(*keys, x, y).unionByName(grown.select(*keys, new_x.alias(x), (F.col("l")[y] * F.pow(new_x / F.col("l")[x], F.lit(power))).alias(y)))

