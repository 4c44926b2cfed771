"""The tables behind figures: data with errors, traces, covariance images, corner histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.operators import diagnostics, noise
from spectrail.plans.inputs import CHAINS_SQL, SPECTRA_SQL, chains, spectra, table


def error_bars(df: DataFrame, value: str, sigma: str) -> DataFrame:
    return df.withColumn("lower", F.col(value) - F.col(sigma)).withColumn("upper", F.col(value) + F.col(sigma))


def realisation(df: DataFrame, value: str, scale: Column, out: str = "realisation") -> DataFrame:
    """Data scaled by a draw's calibration factor."""
    return df.withColumn(out, scale * F.col(value))


def trace(chain: DataFrame, labels: list[str]) -> DataFrame:
    """walker, step, parameter, value of chains with a theta array."""
    named = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col("theta")[i].alias("value")) for i, n in enumerate(labels)])
    return chain.select("walker", "step", F.explode(named).alias("p")).select("walker", "step", "p.parameter", "p.value")


def covariance_image(entries: DataFrame) -> DataFrame:
    """log10 of covariance entries; what is cut off or negative is null."""
    return entries.withColumn("log_c", F.when(F.col("c") > 0, F.log10(F.when(F.col("c") > 0, F.col("c")))))


def corner(draws: DataFrame, columns: dict[str, tuple[float, float, int]]) -> DataFrame:
    """One- and two-dimensional counts of all columns and pairs: x, y (null for one dimension), bins and n."""
    names, out = list(columns), None
    for i, a in enumerate(names):
        for b in [None, *names[i + 1 :]]:
            axes = {k: columns[k] for k in (a, b) if k}
            part = diagnostics.histogram(draws, [], axes).select(
                F.lit(a).alias("x"), F.lit(b).cast("string").alias("y"), F.col(f"{a}_bin").alias("x_bin"), (F.col(f"{b}_bin") if b else F.lit(None).cast("long")).alias("y_bin"), "n")
            out = part if out is None else out.unionByName(part)
    return out


def data_with_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = spectra(spark, sf).withColumn("sigma", F.abs("y") * 0.1 + 0.01)
    return realisation(error_bars(rows, "y", "sigma"), "y", F.lit(1.02)).groupBy("vec_id").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("lower", "upper", "realisation")])


DATA_WITH_ERRORS = f"WITH {SPECTRA_SQL} SELECT vec_id, round(sum(y - abs(y) * 0.1 - 0.01), 6) AS lower, round(sum(y + abs(y) * 0.1 + 0.01), 6) AS upper, round(sum(1.02 * y), 6) AS realisation FROM s GROUP BY 1"


def lnprob_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log-probability at each step over walkers."""
    rows = chains(spark, sf).withColumn("lnprob", -0.5 * F.pow((F.col("value") - 250) / 130, F.lit(2.0)))
    return rows.groupBy("event_type", F.col("step").cast("long").alias("step")).agg(F.round(F.avg("lnprob"), 8).alias("lnprob"), F.count(F.lit(1)).alias("walkers"))


LNPROB_EVOLUTION = f"WITH {CHAINS_SQL} SELECT event_type, step, round(avg(-0.5 * pow((value - 250) / 130, 2)), 8) AS lnprob, count(*) AS walkers FROM c GROUP BY ALL"


def trace_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = chains(spark, sf).select(F.col("user_id").alias("walker"), "step", F.array("value", F.sqrt("value")).alias("theta"))
    return trace(rows, ["value", "root"]).groupBy("walker", "parameter").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


TRACE_TABLE = """
SELECT user_id AS walker, 'value' AS parameter, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1
UNION ALL SELECT user_id, 'root', count(*), round(avg(sqrt(value)), 6) FROM events GROUP BY 1
"""


def covariance_images(spark: SparkSession, sf: str) -> DataFrame:
    points = spectra(spark, sf).select("vec_id", "k", F.col("k").cast("double").alias("x"), (F.abs("y") + 0.1).alias("sd"))
    image = covariance_image(noise.kernel_entries(points, ["vec_id"], "k", "x", "sd", 0.3, 2.0))
    return image.groupBy("vec_id", "i").agg(F.count("log_c").alias("filled"), F.round(F.max("log_c"), 6).alias("top"))


COVARIANCE_IMAGES = f"""
WITH {SPECTRA_SQL}, e AS (SELECT a.vec_id, a.k AS i, b.k AS j, exp(-0.5 * pow((a.k - b.k) / 2.0::DOUBLE, 2)) AS k, (abs(a.y) + 0.1) * (abs(b.y) + 0.1) AS s FROM s a JOIN s b USING (vec_id)),
c AS (SELECT vec_id, i, (CASE WHEN i = j THEN 1 ELSE 0 END + 0.3 * CASE WHEN k < 1e-3 THEN 0 ELSE k END) * s AS c FROM e)
SELECT vec_id, i, count(*) FILTER (c > 0) AS filled, round(max(CASE WHEN c > 0 THEN log10(c) END), 6) AS top FROM c GROUP BY ALL
"""


def corner_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") + 0.5).alias("quantity"), (F.col("l_tax") + 0.005).alias("tax"))
    return corner(rows, {"quantity": (0.0, 50.0, 10), "tax": (0.0, 0.08, 4)})


CORNER_TABLE = """
WITH b AS (SELECT CASE WHEN q >= 50 THEN 11 ELSE CAST(floor(q / 5) AS BIGINT) + 1 END AS qb, CASE WHEN t >= 0.08 THEN 5 ELSE CAST(floor(t * 4 / 0.08) AS BIGINT) + 1 END AS tb FROM (SELECT l_quantity + 0.5 AS q, l_tax + 0.005::DOUBLE AS t FROM lineitem))
SELECT 'quantity' AS x, NULL AS y, qb AS x_bin, NULL::BIGINT AS y_bin, count(*) AS n FROM b GROUP BY qb
UNION ALL SELECT 'tax', NULL, tb, NULL, count(*) FROM b GROUP BY tb UNION ALL SELECT 'quantity', 'tax', qb, tb, count(*) FROM b GROUP BY qb, tb
"""

QUERIES = {
    "data_with_errors": (data_with_errors, DATA_WITH_ERRORS),
    "lnprob_evolution": (lnprob_evolution, LNPROB_EVOLUTION),
    "trace_table": (trace_table, TRACE_TABLE),
    "covariance_image": (covariance_images, COVARIANCE_IMAGES),
    "corner_table": (corner_table, CORNER_TABLE),
}
