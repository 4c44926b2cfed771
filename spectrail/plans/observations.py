"""Queries on ingest: masks, names, units, chunks, blocks, grids and integrals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions import units
from spectrail.operators import align, integrate, select
from spectrail.plans.inputs import SPECTRA_SQL, spectra, table, uniform, uniform_sql
from spectrail.sources.tables import alma_band


def mask_intervals(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "value")
    kinds = [F.struct(F.lit(k).alias("kind"), select.in_interval(F.col("value"), 100.0, 300.0, k).alias("inside")) for k in select.INTERVALS]
    rows = events.select("event_type", F.explode(F.array(*kinds)).alias("m"))
    return rows.groupBy("event_type", F.col("m.kind").alias("kind")).agg(F.count_if("m.inside").alias("n"))


MASK_INTERVALS = """
SELECT event_type, kind, count(*) FILTER (CASE kind WHEN 'closed' THEN value >= 100 AND value <= 300 WHEN 'left-open' THEN value > 100 AND value <= 300
  WHEN 'right-open' THEN value >= 100 AND value < 300 ELSE value > 100 AND value < 300 END) AS n
FROM events, (VALUES ('closed'), ('left-open'), ('right-open'), ('open')) k(kind) GROUP BY ALL
"""


def mask_and_unmask(spark: SparkSession, sf: str) -> DataFrame:
    rows = spectra(spark, sf)
    masked = select.select_waves(select.select_waves(rows, 8, 47, wavelength="k"), 8, 40, "open", wavelength="k")
    both = masked.select("vec_id", F.lit("masked").alias("state"), "mask").unionByName(select.unmask(masked).select("vec_id", F.lit("unmasked").alias("state"), "mask"))
    return both.groupBy("vec_id", "state").agg(F.count_if("mask").alias("n"))


MASK_AND_UNMASK = f"""
WITH {SPECTRA_SQL} SELECT vec_id, 'masked' AS state, count(*) FILTER (k BETWEEN 8 AND 47 AND k > 8 AND k < 40) AS n FROM s GROUP BY vec_id
UNION ALL SELECT vec_id, 'unmasked', count(*) FROM s GROUP BY vec_id
"""


def finite_rows(spark: SparkSession, sf: str) -> DataFrame:
    fine = select.finite_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return fine.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


FINITE_ROWS = """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
WHERE isfinite(l_quantity) AND isfinite(l_extendedprice) AND isfinite(l_discount) AND isfinite(l_tax) GROUP BY 1
"""


def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = select.datasets_of_chunks(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("chunk"), "l_extendedprice"))
    return rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


CHUNK_SPLIT = """
SELECT d AS dataset_id, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM lineitem JOIN (SELECT f, CAST(row_number() OVER (ORDER BY f) AS INT) AS d FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem)) ON f = l_returnflag GROUP BY d
"""


def gap_split(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "value")
    split = select.gap_split(events, ["user_id"], "value", ["value", "event_id"], 20.0)
    return split.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


GAP_SPLIT = """
WITH d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events),
g AS (SELECT *, max(CASE WHEN gap > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS past FROM d)
SELECT user_id, CAST(1 + past AS INT) AS chunk, count(*) AS n, min(value) AS low, max(value) AS high FROM g GROUP BY ALL
"""


def filter_names(spark: SparkSession, sf: str) -> DataFrame:
    """Observed names against a library that lacks some."""
    prefix = F.when(F.col("p_size") % 3 == 0, "WISE").when(F.col("p_size") % 3 == 1, "Spitzer").otherwise("WISE_RSR")
    parts = table(spark, sf, "part").select("p_partkey", "p_size", prefix.alias("prefix"), select.filter_name(F.concat(prefix, F.lit(":"), F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string"))).alias("filter"))
    matched, warned = select.match_filters(parts, parts.where("p_partkey % 2 = 0"))
    tagged = matched.withColumn("matched", F.lit(True)).unionByName(warned.withColumn("matched", F.lit(False)))
    return tagged.groupBy("prefix", "matched").agg(F.count(F.lit(1)).alias("n"), F.min("filter").alias("first"), F.max("filter").alias("last"))


FILTER_NAMES = """
WITH p AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'WISE' WHEN 1 THEN 'Spitzer' ELSE 'WISE_RSR' END AS prefix FROM part),
n AS (SELECT p_partkey, prefix, replace(replace(replace(replace(replace(prefix || ':' || p_brand || '/' || p_size, ':', '_'), '/', '_'), 'WISE', 'WISE_RSR'), 'Spitzer', 'SPITZER'), 'RSR_RSR', 'RSR') AS filter FROM p)
SELECT prefix, filter IN (SELECT filter FROM n WHERE p_partkey % 2 = 0) AS matched, count(*) AS n, min(filter) AS first, max(filter) AS last FROM n GROUP BY ALL
"""


def mag_to_flux(spark: SparkSession, sf: str) -> DataFrame:
    zero = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_discount", "l_tax").join(zero, "l_partkey")
    flux, error = units.magnitude_to_jy(F.col("l_discount") * 10, F.col("l_tax"), F.col("p_retailprice"))
    return rows.select("l_returnflag", flux.alias("f"), error.alias("e")).groupBy("l_returnflag").agg(F.round(F.avg("f"), 6).alias("flux"), F.round(F.avg("e"), 6).alias("error"))


MAG_TO_FLUX = """
SELECT l_returnflag, round(avg(p_retailprice * pow(10, -0.4 * 10 * l_discount)), 6) AS flux,
  round(avg(p_retailprice * pow(10, -0.4 * 10 * l_discount) * sinh(0.4 * l_tax * ln(10))), 6) AS error
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1
"""


def unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    x_unit = F.when(F.col("l_linestatus") == "O", "um").otherwise("GHz")
    f_unit = F.when(F.col("l_returnflag") == "A", "mJy").when(F.col("l_returnflag") == "N", "W/m2/um").otherwise("erg/s/cm2/Hz")
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", units.to_um(F.col("l_quantity"), x_unit).alias("w"), F.col("l_extendedprice").alias("v"), f_unit.alias("u"))
    jy = units.to_jy(F.col("v"), F.col("u"), F.col("w"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.log10(F.avg("w")), 9).alias("wavelength"), F.round(F.log10(F.avg(jy)), 9).alias("jy"))


UNIT_CONVERT = """
WITH r AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 2.99792458e14 / (l_quantity * 1e9) END AS w FROM lineitem)
SELECT l_returnflag, l_linestatus, round(log10(avg(w)), 9) AS wavelength,
  round(log10(avg(l_extendedprice * CASE l_returnflag WHEN 'A' THEN 1e-3 WHEN 'N' THEN 1e26 / 2.99792458e14 * w * w ELSE 1e23 END)), 9) AS jy
FROM r GROUP BY ALL
"""


def vstack_blocks(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stacked = select.stack_blocks(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus <> 'O'"))
    return stacked.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


VSTACK_BLOCKS = """
SELECT CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS INT) AS module, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
"""


def pretty_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.sqrt("p_retailprice").alias("value"), (F.col("p_size") > 10).alias("mask"))
    return select.pretty_rows(rows, ["p_partkey", "value"])


PRETTY_ROWS = "SELECT p_partkey, printf('%.2e', sqrt(p_retailprice)) AS value FROM part WHERE p_size > 10"


def first_filters(spark: SparkSession, sf: str) -> DataFrame:
    return select.first_of_each(table(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey")


FIRST_FILTERS = "SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY 1"


def redshift_rest(spark: SparkSession, sf: str) -> DataFrame:
    z = F.pmod("vec_id", F.lit(5)) / 10
    return spectra(spark, sf).groupBy("vec_id").agg(F.round(F.sum(select.rest_frame(F.col("k") + 1, z) * F.col("y")), 6).alias("moment"))


REDSHIFT_REST = f"WITH {SPECTRA_SQL} SELECT vec_id, round(sum((k + 1) / (1 + (vec_id % 5) / 10.0::DOUBLE) * y), 6) AS moment FROM s GROUP BY 1"


def opacity_units(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped opacities in units that depend on the species' place."""
    rows = spectra(spark, sf).select("vec_id", F.pmod("k", F.lit(8)).alias("species"), "y")
    fixed = integrate.opacity_in_cm(F.col("y"), F.col("species"), {2: 1e-4, 5: 2.71 * (4 / 3) * 1e-4})
    return rows.groupBy("vec_id", "species").agg(F.round(F.sum(fixed), 9).alias("q"))


OPACITY_UNITS = f"""
WITH {SPECTRA_SQL} SELECT vec_id, k % 8 AS species, round(sum(greatest(y, 0) * CASE k % 8 WHEN 2 THEN 1e-4 WHEN 5 THEN 2.71::DOUBLE * (4 / 3.0::DOUBLE) * 1e-4 ELSE 1 END), 9) AS q FROM s GROUP BY ALL
"""


def _targets(spark: SparkSession, sf: str, first: float, step: float) -> DataFrame:
    ids = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j"))
    return ids.select("vec_id", "j", (first + step * F.col("j") + uniform(F.col("vec_id"), F.col("j"))).alias("x"))


def interp_linear(spark: SparkSession, sf: str) -> DataFrame:
    samples = spectra(spark, sf).select("vec_id", F.col("k").cast("double").alias("x"), "y")
    out = align.interpolate(samples, _targets(spark, sf, -2.0, 4.25), ["vec_id"], "x", "y", "clamp")
    return out.select("vec_id", "j", F.round("y", 6).alias("y"))


TARGETS_SQL = f"t AS (SELECT vec_id, embedding AS e, CAST(j AS INT) AS j, -2 + 4.25::DOUBLE * j + {uniform_sql('vec_id', 'j')} AS x FROM embeddings, range(16) r(j))"

INTERP_LINEAR = f"""
WITH {TARGETS_SQL}, b AS (SELECT vec_id, e, j, least(greatest(x, 0), 63) AS x, CAST(least(greatest(floor(x), 0), 62) AS INT) AS k FROM t),
y AS (SELECT vec_id, j, x - k AS d, e[k + 1]::DOUBLE AS l, e[k + 2]::DOUBLE AS h FROM b)
SELECT vec_id, j, round(l + d * (h - l), 6) AS y FROM y
"""


def interp_log(spark: SparkSession, sf: str) -> DataFrame:
    samples = spectra(spark, sf).select("vec_id", F.col("k").cast("double").alias("x"), (F.abs("y") + 1).alias("y"))
    out = align.interpolate(samples, _targets(spark, sf, -2.0, 4.25), ["vec_id"], "x", "y", "extrapolate", log_y=True)
    return out.select("vec_id", "j", F.round("y", 6).alias("y"))


INTERP_LOG = f"""
WITH {TARGETS_SQL}, b AS (SELECT vec_id, e, j, x, CAST(least(greatest(floor(x), 0), 62) AS INT) AS k FROM t),
y AS (SELECT vec_id, j, x - k AS d, log10(abs(e[k + 1]::DOUBLE) + 1) AS l, log10(abs(e[k + 2]::DOUBLE) + 1) AS h FROM b)
SELECT vec_id, j, round(pow(10, l + d * (h - l)), 6) AS y FROM y
"""


def interp_loglog_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Log-log interpolation; beyond the samples the last known value falls with the square of x."""
    samples = spectra(spark, sf).select("vec_id", (F.col("k") + 1.0).alias("x"), (F.abs("y") + 1).alias("y"))
    inside = align.interpolate(samples, _targets(spark, sf, 1.0, 5.0), ["vec_id"], "x", "y", "null", log_x=True, log_y=True)
    return align.rayleigh_jeans_patch(inside, ["vec_id"], "x", "y").select("vec_id", "j", F.round("y", 6).alias("y"))


INTERP_LOGLOG_TAIL = f"""
WITH {SPECTRA_SQL}, t AS (SELECT vec_id, CAST(j AS INT) AS j, 1 + 5.0::DOUBLE * j + {uniform_sql('vec_id', 'j')} AS x FROM embeddings, range(16) r(j)),
b AS (SELECT vec_id, j, x, CAST(floor(x) AS INT) AS k FROM t),
i AS (SELECT b.vec_id, j, x, CASE WHEN b.k < 64 THEN pow(10, log10(abs(l.y) + 1) + (log10(x) - log10(b.k)) / (log10(b.k + 1) - log10(b.k)) * (log10(abs(h.y) + 1) - log10(abs(l.y) + 1))) END AS y
  FROM b LEFT JOIN s l ON l.vec_id = b.vec_id AND l.k = b.k - 1 LEFT JOIN s h ON h.vec_id = b.vec_id AND h.k = b.k)
SELECT vec_id, j, round(coalesce(y, last_value(y IGNORE NULLS) OVER w * pow(x / last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER w, -2)), 6) AS y
FROM i WINDOW w AS (PARTITION BY vec_id ORDER BY x ROWS UNBOUNDED PRECEDING)
"""


def rebin_exact(spark: SparkSession, sf: str) -> DataFrame:
    source = spectra(spark, sf).select("vec_id", F.col("k").cast("double").alias("x"), "y")
    bins = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j")).select("vec_id", (2 + 3.7 * F.col("j")).alias("x"))
    out = align.rebin(source, bins, ["vec_id"], "x", "y", 4.0)
    return out.select("vec_id", F.round((F.col("x") - 2) / 3.7).cast("int").alias("j"), F.round("y", 6).alias("y"))


REBIN_EXACT = f"""
WITH {SPECTRA_SQL}, b AS (SELECT CAST(j AS INT) AS j, 2 + 3.7::DOUBLE * j - 1.85 AS lo, 2 + 3.7::DOUBLE * j + 1.85 AS hi FROM range(16) r(j)),
o AS (SELECT vec_id, j, y, least(k + 0.5, hi) - greatest(k - 0.5, lo) AS w FROM s JOIN b ON k - 0.5 < hi AND k + 0.5 > lo)
SELECT vec_id, j, round(sum(y * w) / sum(w), 6) AS y FROM o WHERE w > 0 GROUP BY ALL
"""


def _filters(spark: SparkSession) -> DataFrame:
    """Top hats and triangles on the grid 1 to 64, for either detector."""
    shape = F.when(F.col("b") % 2 == 0, F.when(F.abs(F.col("wavelength") - (F.col("b") * 16 + 8)) <= 6, 1.0).otherwise(0.0)).otherwise(F.greatest(1 - F.abs(F.col("wavelength") - (F.col("b") * 16 + 8)) / 7, F.lit(0.0)))
    grid = spark.range(4).select(F.col("id").cast("int").alias("b")).select("b", F.explode(F.sequence(F.lit(1), F.lit(64))).alias("w")).select("b", F.col("w").cast("double").alias("wavelength"))
    return grid.select("b", F.explode(F.array(F.lit("photon"), F.lit("energy"))).alias("detector"), "wavelength", shape.alias("transmission")).select(F.concat("detector", F.col("b").cast("string")).alias("filter"), "detector", "wavelength", "transmission")


FILTERS_SQL = """
g AS (SELECT b, d AS detector, CAST(w AS DOUBLE) AS x, CASE WHEN b % 2 = 0 THEN CASE WHEN abs(w - (b * 16 + 8)) <= 6 THEN 1.0 ELSE 0.0 END ELSE greatest(1 - abs(w - (b * 16 + 8)) / 7.0::DOUBLE, 0) END AS t
  FROM range(4) r(b), range(1, 65) q(w), (VALUES ('photon'), ('energy')) v(d)),
f AS (SELECT detector || b AS filter, x, CASE WHEN detector = 'photon' THEN x * t ELSE t END AS m FROM g)
"""


def band_photometry(spark: SparkSession, sf: str) -> DataFrame:
    flux = spectra(spark, sf).select("vec_id", (F.col("k") + 1.0).alias("wavelength"), (F.abs("y") + 0.5).alias("flux"))
    out = integrate.band_fluxes(flux, _filters(spark), ["vec_id"])
    return out.select("vec_id", "filter", F.round("lpivot", 6).alias("lpivot"), F.round("flux", 6).alias("flux"))


BAND_PHOTOMETRY = f"""
WITH {SPECTRA_SQL}, {FILTERS_SQL}, j AS (SELECT vec_id, filter, x, m, abs(y) + 0.5 AS v FROM s JOIN f ON x = k + 1),
a AS (SELECT vec_id, filter, 0.5 * (m * v / (x * x) + lead(m * v / (x * x)) OVER w) * (lead(x) OVER w - x) AS a, 0.5 * (m + lead(m) OVER w) * (lead(x) OVER w - x) AS b,
  0.5 * (m / (x * x) + lead(m / (x * x)) OVER w) * (lead(x) OVER w - x) AS c FROM j WINDOW w AS (PARTITION BY vec_id, filter ORDER BY x))
SELECT vec_id, filter, round(sqrt(sum(b) / sum(c)), 6) AS lpivot, round(sum(a) / sum(c), 6) AS flux FROM a GROUP BY ALL
"""


def pivot_wavelengths(spark: SparkSession, sf: str) -> DataFrame:
    return integrate.pivot_wavelength(_filters(spark)).select("filter", F.round("lpivot", 9).alias("lpivot"))


PIVOT_WAVELENGTHS = f"""
WITH {FILTERS_SQL}, a AS (SELECT filter, 0.5 * (m + lead(m) OVER w) * (lead(x) OVER w - x) AS b, 0.5 * (m / (x * x) + lead(m / (x * x)) OVER w) * (lead(x) OVER w - x) AS c FROM f WINDOW w AS (PARTITION BY filter ORDER BY x))
SELECT filter, round(sqrt(sum(b) / sum(c)), 9) AS lpivot FROM a GROUP BY 1
"""


def trapz(spark: SparkSession, sf: str) -> DataFrame:
    v = spectra(spark, sf).select(F.lit("spectrum").alias("kind"), F.col("vec_id").alias("id"), F.col("k").cast("double").alias("x"), "y", F.lit(0).cast("long").alias("o"))
    e = table(spark, sf, "events").select(F.lit("events").alias("kind"), F.col("user_id").alias("id"), F.col("value").alias("x"), F.sqrt("value").alias("y"), F.col("event_id").alias("o"))
    out = integrate.trapz(v.unionByName(e), ["kind", "id"], "x", "y", order=["x", "o"])
    return out.select("kind", "id", F.round("integral", 6).alias("integral"))


TRAPZ = f"""
WITH {SPECTRA_SQL}, r AS (SELECT 'spectrum' AS kind, vec_id AS id, CAST(k AS DOUBLE) AS x, y, 0 AS o FROM s UNION ALL SELECT 'events', user_id, value, sqrt(value), event_id FROM events),
a AS (SELECT kind, id, 0.5 * (y + lead(y) OVER w) * (lead(x) OVER w - x) AS a FROM r WINDOW w AS (PARTITION BY kind, id ORDER BY x, o))
SELECT kind, id, round(coalesce(sum(a), 0), 6) AS integral FROM a GROUP BY ALL
"""


def trapz_arrays(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 0.5)
    y = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(integrate.array_trapz(x, y), 6).alias("integral"))


TRAPZ_ARRAYS = f"WITH {SPECTRA_SQL} SELECT vec_id, round(0.5 * (sum(y) - 0.5 * sum(y) FILTER (k IN (0, 63))), 6) AS integral FROM s GROUP BY 1"


def opacity_mix(spark: SparkSession, sf: str) -> DataFrame:
    q = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.greatest(v, F.lit(0.0)))
    abundances = F.array(*[F.lit(0.05 * (i + 1)) for i in range(8)])
    rows = table(spark, sf, "embeddings").select("vec_id", q.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("g"))
    return rows.select("vec_id", "g", F.round(integrate.mix(F.slice("q", F.col("g") * 8 + 1, F.lit(8)), abundances), 6).alias("opacity"))


OPACITY_MIX = f"WITH {SPECTRA_SQL} SELECT vec_id, CAST(floor(k / 8.0) AS INT) AS g, round(sum(greatest(y, 0) * 0.05::DOUBLE * (k % 8 + 1)), 6) AS opacity FROM s GROUP BY ALL"


def tail_extend(spark: SparkSession, sf: str) -> DataFrame:
    source = spectra(spark, sf).select("vec_id", (F.col("k") + 1.0).alias("x"), (F.abs("y") + 0.5).alias("y"))
    grown = align.tail(source, ["vec_id"], "x", "y", 6400.0, 20)
    return grown.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("x"), 4).alias("reach"), F.round(F.sum("y"), 6).alias("total"))


TAIL_EXTEND = f"""
WITH {SPECTRA_SQL}, r AS (SELECT vec_id, k + 1.0::DOUBLE AS x, abs(y) + 0.5 AS y FROM s), l AS (SELECT vec_id, y FROM r WHERE x = 64),
t AS (SELECT vec_id, pow(10, log10(64) + i * (log10(6400) - log10(64)) / 20) AS x, y FROM l, range(1, 21) g(i)),
a AS (SELECT * FROM r UNION ALL SELECT vec_id, x, y * pow(x / 64, -4) FROM t)
SELECT vec_id, count(*) AS n, round(max(x), 4) AS reach, round(sum(y), 6) AS total FROM a GROUP BY 1
"""


def alma_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = alma_band(spark, [(84.0, 116.0), (125.0, 163.0)])
    return out.select(F.round("frequency_ghz", 6).alias("frequency_ghz"), F.round("wavelength", 6).alias("wavelength"), "transmission")


ALMA_WINDOWS = """
WITH f AS (SELECT 0.95::DOUBLE * 84 + (1.05::DOUBLE * 163 - 0.95::DOUBLE * 84) / 199 * i AS f FROM range(200) r(i))
SELECT round(f, 6) AS frequency_ghz, round(2.99792458e14 / (f * 1e9), 6) AS wavelength, CASE WHEN (f > 84 AND f < 116) OR (f > 125 AND f < 163) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS transmission FROM f
"""


def grids(spark: SparkSession, sf: str) -> DataFrame:
    out = [integrate.grid(spark, 2.0, 200.0, 50, s).withColumn("spacing", F.lit(s)) for s in ("linear", "log", "reciprocal")]
    r = integrate.resolution_grid(spark, 2.0, 200.0, 20.0).withColumn("spacing", F.lit("resolution"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(r).select("spacing", "grid_idx", F.round("wavelength", 6).alias("wavelength"))


GRIDS = """
SELECT 'linear' AS spacing, CAST(i AS INT) AS grid_idx, round(2 + 198.0::DOUBLE / 49 * i, 6) AS wavelength FROM range(50) r(i)
UNION ALL SELECT 'log', CAST(i AS INT), round(pow(10, log10(2) + (log10(200) - log10(2)) / 49 * i), 6) FROM range(50) r(i)
UNION ALL SELECT 'reciprocal', CAST(i AS INT), round(1 / (1 / 200.0::DOUBLE + (1 / 2.0::DOUBLE - 1 / 200.0::DOUBLE) / 49 * (49 - i)), 6) FROM range(50) r(i)
UNION ALL SELECT 'resolution', CAST(i AS INT), round(2 * pow(1 + 1 / 20.0::DOUBLE, i), 6) FROM range(95) r(i)
"""


def size_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return integrate.size_distribution(spark, 0.005, 0.25, 101, -3.5, 0.1).select(F.round("size_um", 9).alias("size_um"), F.round("number", 9).alias("number"))


SIZE_DISTRIBUTION = """
WITH a AS (SELECT 0.005::DOUBLE + (0.25::DOUBLE - 0.005::DOUBLE) / 100 * i AS a FROM range(101) r(i)), n AS (SELECT a, pow(a, -3.5) * exp(-a / 0.1) AS n FROM a)
SELECT round(a, 9) AS size_um, round(n / sum(n) OVER (), 9) AS number FROM n
"""

QUERIES = {
    "mask_intervals": (mask_intervals, MASK_INTERVALS),
    "mask_and_unmask": (mask_and_unmask, MASK_AND_UNMASK),
    "finite_rows": (finite_rows, FINITE_ROWS),
    "chunk_split": (chunk_split, CHUNK_SPLIT),
    "gap_split": (gap_split, GAP_SPLIT),
    "filter_names": (filter_names, FILTER_NAMES),
    "mag_to_flux": (mag_to_flux, MAG_TO_FLUX),
    "unit_convert": (unit_convert, UNIT_CONVERT),
    "vstack_blocks": (vstack_blocks, VSTACK_BLOCKS),
    "pretty_rows": (pretty_rows, PRETTY_ROWS),
    "first_filters": (first_filters, FIRST_FILTERS),
    "redshift_rest": (redshift_rest, REDSHIFT_REST),
    "opacity_units": (opacity_units, OPACITY_UNITS),
    "interp_linear": (interp_linear, INTERP_LINEAR),
    "interp_log": (interp_log, INTERP_LOG),
    "interp_loglog_tail": (interp_loglog_tail, INTERP_LOGLOG_TAIL),
    "rebin_exact": (rebin_exact, REBIN_EXACT),
    "band_photometry": (band_photometry, BAND_PHOTOMETRY),
    "pivot_wavelengths": (pivot_wavelengths, PIVOT_WAVELENGTHS),
    "trapz": (trapz, TRAPZ),
    "trapz_arrays": (trapz_arrays, TRAPZ_ARRAYS),
    "opacity_mix": (opacity_mix, OPACITY_MIX),
    "tail_extend": (tail_extend, TAIL_EXTEND),
    "alma_band": (alma_windows, ALMA_WINDOWS),
    "grids": (grids, GRIDS),
    "size_distribution": (size_distribution, SIZE_DISTRIBUTION),
}
