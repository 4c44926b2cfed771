"""Queries on file formats: the driver's tables as files of each format, read back, with SQL on the tables.

Files hold at most a block of rows or one spectrum each, made on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions import units
from spectrail.operators import align, decks, diagnostics, integrate
from spectrail.plans.inputs import SPECTRA_SQL, scratch, spectra, table
from spectrail.sources import tables, writers

FILE_ROWS = 500


def _vectors_as_files(spark: SparkSession, sf: str, make: Callable[[np.ndarray], bytes], ending: str = "dat") -> DataFrame:
    """A file for each embedding: path, content."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"path": [f"{i}.{ending}" for i in b["vec_id"]], "content": [make(np.asarray(v, dtype=float)) for v in b["embedding"]]})

    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "path string, content binary")


def _id(ending: str = "dat"):
    return F.regexp_replace("file", rf"\.{ending}$", "").cast("long").alias("vec_id")


def source_votable(spark: SparkSession, sf: str) -> DataFrame:
    """Photometry from VOTables of up to FILE_ROWS parts, some without a flux."""
    fields = [{"name": "sed_filter", "datatype": "char", "arraysize": "*"}, {"name": "sed_flux", "datatype": "double", "unit": "mJy"}, {"name": "sed_eflux", "datatype": "double", "unit": "mJy"}]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for at in range(0, len(b), FILE_ROWS):
                part = b.iloc[at : at + FILE_ROWS]
                rows = [(f"{brand}/{key}", None if size % 10 == 0 else price, size * 0.5) for key, brand, price, size in part.itertuples(index=False)]
                yield pd.DataFrame({"path": [f"{part.iloc[0, 0]}.vot"], "content": [writers.votable(fields, rows)]})

    files = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size").mapInPandas(run, "path string, content binary")
    out = tables.read_votable_photometry(spark, files)
    return out.select("filter", F.round("flux", 6).alias("flux"), F.round("err", 6).alias("err"), "unit")


SOURCE_VOTABLE = """
SELECT p_brand || '/' || p_partkey AS filter, CASE WHEN p_size % 10 = 0 THEN NULL ELSE round(p_retailprice, 6) END AS flux, round(p_size * 0.5::DOUBLE, 6) AS err, 'mJy' AS unit FROM part
"""


def source_votable_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    fields = [{"name": "wave", "datatype": "double", "arraysize": "*"}, {"name": "flux", "datatype": "double", "arraysize": "*"}]
    files = _vectors_as_files(spark, sf, lambda v: writers.votable(fields, [(np.arange(1.0, len(v) + 1), v)]))
    out = tables.read_votable_spectrum(spark, files, "wave", "flux")
    return out.groupBy(_id()).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("flux") * F.col("wavelength")), 6).alias("moment"), F.round(F.log10(F.max("nu")), 9).alias("nu"))


SOURCE_VOTABLE_SPECTRUM = f"WITH {SPECTRA_SQL} SELECT vec_id, count(*) AS n, round(sum(y * (k + 1)), 6) AS moment, round(log10(2.99792458e14), 9) AS nu FROM s GROUP BY 1"


def source_spitzer_low(spark: SparkSession, sf: str) -> DataFrame:
    """Images with wavelengths against their order, some errors missing and four modules."""
    head = {f"COL{i + 1:02d}DEF": n for i, n in enumerate(("wavelength", "flux", "error (RMS+SYS)", "module"))}

    def make(v: np.ndarray) -> bytes:
        k = np.arange(len(v))
        return writers.fits_image(np.column_stack([64.0 - k, v, np.where(k % 13 == 0, np.nan, 0.1), k % 4, np.full(len(v), 9.0)]), head)

    out = tables.read_spectrum(spark, _vectors_as_files(spark, sf, make), "SPITZER-YAAAR")
    return out.groupBy(_id(), "chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.col("wavelength")), 6).alias("moment"))


SOURCE_SPITZER_LOW = f"""
WITH {SPECTRA_SQL} SELECT vec_id, CAST(CASE WHEN k % 4 < 2 THEN 1 ELSE 2 END AS INT) AS chunk, count(*) AS n, round(sum(y * (64 - k)), 6) AS moment FROM s WHERE k % 13 <> 0 GROUP BY ALL
"""


def source_spitzer_high(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of 16 points with a jump in the middle, the last order beyond those that are split."""
    head = {f"COL{i + 1:02d}DEF": n for i, n in enumerate(("wavelength", "flux", "flux_error", "IRS_order"))}

    def make(v: np.ndarray) -> bytes:
        k = np.arange(len(v))
        return writers.fits_image(np.column_stack([10 + 0.1 * k + 6 * (k % 16 >= 8), v, np.full(len(v), 0.1), np.where(k < 48, 11 + k // 16, 30)]), head)

    out = tables.read_spectrum(spark, _vectors_as_files(spark, sf, make), "SPITZER-YAAAR_OPTDIFFHR")
    return out.groupBy(_id(), "irs_order", "chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


SOURCE_SPITZER_HIGH = f"""
WITH {SPECTRA_SQL} SELECT vec_id, CAST(CASE WHEN k < 48 THEN 11 + k // 16 ELSE 30 END AS BIGINT) AS irs_order, CAST(CASE WHEN k >= 48 THEN 0 WHEN k % 16 < 8 THEN 1 ELSE 2 END AS INT) AS chunk, count(*) AS n, round(sum(y), 6) AS total
FROM s GROUP BY ALL
"""


def source_fits_table(spark: SparkSession, sf: str) -> DataFrame:
    """User-named binary tables in GHz and mJy."""
    make = lambda v: writers.fits_table({"freq": 100.0 + np.arange(len(v)), "s": v, "ds": np.full(len(v), 0.5, dtype="f4")})
    out = tables.read_spectrum(spark, _vectors_as_files(spark, sf, make), "User-Defined", "fits", wavelength="freq", flux="s", uncertainty="ds", wavelength_unit="GHz", flux_unit="mJy")
    return out.groupBy(_id()).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") / F.col("wavelength")) * 1e6, 6).alias("moment"), F.round(F.max("uncertainty"), 9).alias("uncertainty"))


SOURCE_FITS_TABLE = f"""
WITH {SPECTRA_SQL} SELECT vec_id, count(*) AS n, round(sum(y * 1e-3 / (2.99792458e14 / ((100.0::DOUBLE + k) * 1e9))) * 1e6, 6) AS moment, 0.0005::DOUBLE AS uncertainty FROM s GROUP BY 1
"""


def source_sws(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of 14 columns that go by place."""
    make = lambda v: writers.fits_table({"a": 1.0 + np.arange(len(v)), "b": v, "c": np.abs(v), **{f"x{i}": np.zeros(len(v), dtype="i4") for i in range(11)}})
    out = tables.read_spectrum(spark, _vectors_as_files(spark, sf, make), "SWS-AAR")
    return out.groupBy(_id()).agg(F.round(F.sum(F.col("wavelength") * F.col("value")), 6).alias("moment"), F.round(F.max("uncertainty"), 6).alias("uncertainty"))


SOURCE_SWS = f"WITH {SPECTRA_SQL} SELECT vec_id, round(sum((k + 1) * y), 6) AS moment, round(max(abs(y)), 6) AS uncertainty FROM s GROUP BY 1"


def source_lrs(spark: SparkSession, sf: str) -> DataFrame:
    """Two blocks of wavelength and power, parted by dashes."""

    def make(v: np.ndarray) -> bytes:
        lines = [f"{8 + i} {(abs(x) + 1) * 1e-12!r}" for i, x in enumerate(v.tolist())]
        return "\n".join(["Object", *lines[:32], "-" * 19, *lines[32:], ""]).encode()

    out = tables.read_spectrum(spark, _vectors_as_files(spark, sf, make), "IRAS-LRS")
    return out.groupBy(_id(), "module").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("jy"))


SOURCE_LRS = f"""
WITH {SPECTRA_SQL} SELECT vec_id, CAST(1 + k // 32 AS INT) AS module, count(*) AS n, round(sum((abs(y) + 1) * 1e-12 * (8 + k) * 1e-6 / 2.99792458e8 * 1e26), 6) AS jy FROM s GROUP BY ALL
"""


def source_user_text(spark: SparkSession, sf: str) -> DataFrame:
    """A delimited file with the user's names, written and read through the shared folder."""
    path = scratch(spark, "user-text")
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") * 1000).alias("nm"), F.col("l_extendedprice").alias("milli"), F.col("l_tax").alias("e"), F.col("l_linenumber").alias("chunk"))
    rows.write.option("header", True).csv(path)
    out = tables.read_spectrum(spark, path, "User-Defined", "text", wavelength="nm", flux="milli", uncertainty="e", wavelength_unit="nm", flux_unit="mJy")
    return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wavelength"), 6).alias("wavelength"), F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("uncertainty"), 9).alias("uncertainty"))


SOURCE_USER_TEXT = """
SELECT CAST(l_linenumber AS INT) AS chunk, count(*) AS n, round(avg(l_quantity), 6) AS wavelength, round(avg(l_extendedprice / 1000), 6) AS value, round(avg(l_tax / 1000), 9) AS uncertainty FROM lineitem GROUP BY 1
"""


def _opacity_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each label's mean spectrum, with a second value column that isn't read."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    mean = spectra(spark, sf).join(labels, "vec_id").groupBy("label", "k").agg(F.avg(F.abs("y")).alias("q"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda r: F.concat_ws(" ", (r["k"] + 1).cast("string"), r["q"].cast("string"), F.lit("9.0")))
    content = F.concat(F.lit("#lam q_sub q\n"), F.array_join(lines, "\n")).cast("binary")
    name = F.concat(F.lit("/opacities/s"), F.lpad(F.col("label").cast("string"), 6, "0"), F.lit("_sub.q"))
    return mean.groupBy("label").agg(content.alias("content")).select(name.alias("path"), "content")


MEANS_SQL = f"{SPECTRA_SQL}, p AS (SELECT label, k, avg(abs(y)) AS q FROM s JOIN embeddings USING (vec_id) GROUP BY ALL), o AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS r FROM (SELECT DISTINCT label FROM embeddings))"


def source_opacities(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of species; their order is that of the names."""
    out = tables.read_opacities(spark, _opacity_files(spark, sf))
    return out.groupBy("species", "species_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("wavelength") * F.col("q")), 6).alias("moment"))


SOURCE_OPACITIES = f"""
WITH {MEANS_SQL} SELECT 's' || lpad(CAST(label AS VARCHAR), 6, '0') AS species, CAST(r AS INT) AS species_idx, count(*) AS n, round(sum((k + 1) * q), 6) AS moment FROM p JOIN o USING (label) GROUP BY label, r
"""


def source_opacity_list(spark: SparkSession, sf: str) -> DataFrame:
    """The same in the order of a list, against that of the names."""
    files = _opacity_files(spark, sf)
    name = F.concat(F.element_at(F.split("path", "/"), -1), F.lit("  "))
    listed = files.agg(F.array_join(F.sort_array(F.collect_list(name), False), "\n").cast("binary").alias("content")).select(F.lit("list.txt").alias("path"), "content")
    out = tables.read_opacity_list(spark, listed, files)
    return out.groupBy("species", "species_idx").agg(F.round(F.sum("q"), 6).alias("q"))


SOURCE_OPACITY_LIST = f"""
WITH {MEANS_SQL} SELECT 's' || lpad(CAST(label AS VARCHAR), 6, '0') || '_sub.q' AS species, CAST((SELECT max(r) FROM o) - r AS INT) AS species_idx, round(sum(q), 6) AS q FROM p JOIN o USING (label) GROUP BY label, r
"""


def source_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Two-header filter files in nm, photon and energy detectors by turns."""
    make = lambda v: "\n".join(["wavelength,transmission", f"nm,{'Photon' if v[0] > 0 else 'Energy'}", *(f"{1000 * (i + 1)},{abs(x)!r}" for i, x in enumerate(v.tolist()))]).encode()
    out = tables.read_filter_csv(spark, _vectors_as_files(spark, sf, make, "csv"))
    return out.groupBy("filter", "detector").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("wavelength") * F.col("transmission")), 6).alias("moment"))


SOURCE_FILTERS = f"""
WITH {SPECTRA_SQL} SELECT CAST(vec_id AS VARCHAR) AS filter, CASE WHEN max(y) FILTER (k = 0) > 0 THEN 'photon' ELSE 'energy' END AS detector, count(*) AS n, round(sum((k + 1) * abs(y)), 6) AS moment FROM s GROUP BY 1
"""


def source_eso_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Text curves, through the two-header layout and back."""
    make = lambda v: ("# curve\n" + "".join(f" {i + 1}.5  {abs(x)!r}\n" for i, x in enumerate(v.tolist()))).encode()
    curves = tables.read_eso_filter(spark, _vectors_as_files(spark, sf, make))
    path = scratch(spark, "eso")
    tables.write_filter_csv(curves.groupBy("wavelength").agg(F.avg("transmission").alias("transmission")), path, "energy", "um")
    out = tables.read_filter_csv(spark, path)
    return out.select("detector", "wavelength", F.round("transmission", 6).alias("transmission"))


SOURCE_ESO_FILTERS = f"WITH {SPECTRA_SQL} SELECT 'energy' AS detector, k + 1.5::DOUBLE AS wavelength, round(avg(abs(y)), 6) AS transmission FROM s GROUP BY k"


def source_filter_library(spark: SparkSession, sf: str) -> DataFrame:
    """A library with repeated names, written without and read for some."""
    path = scratch(spark, "library")
    detector = F.when(F.col("p_partkey") % 2 == 0, "photon").otherwise("energy")
    grid = F.explode(F.sequence(F.lit(1), F.lit(8)))
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("filter"), detector.alias("detector"), grid.alias("w"))
    tables.write_filter_library(parts.select("filter", "detector", F.col("w").cast("double").alias("wavelength"), F.when(F.col("detector") == "photon", 0.5).otherwise(0.25).alias("transmission")), path)
    out = tables.read_filter_library(spark, path, ["Brand#11", "Brand#12", "Brand#23"])
    return out.groupBy("filter", "detector").agg(F.count(F.lit(1)).alias("n"), F.sum("transmission").alias("total"))


SOURCE_FILTER_LIBRARY = """
WITH f AS (SELECT p_brand AS filter, min(CASE WHEN p_partkey % 2 = 0 THEN 'photon' ELSE 'energy' END) AS detector FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') GROUP BY 1)
SELECT filter, detector, 8::BIGINT AS n, CASE detector WHEN 'photon' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS total FROM f
"""


def source_radiative_transfer(spark: SparkSession, sf: str) -> DataFrame:
    make = lambda v: "\n".join(["1 2.5e-12 3", *(f"  {i + 1} {abs(x)!r}" for i, x in enumerate(v.tolist())), ""]).encode()
    out = tables.read_radiative_transfer(spark, _vectors_as_files(spark, sf, make))
    return out.groupBy(_id()).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flux"), 6).alias("jy"))


SOURCE_RADIATIVE_TRANSFER = f"WITH {SPECTRA_SQL} SELECT vec_id, count(*) AS n, round(sum(abs(y) * 2.5e-12 * (k + 1) * 1e-6 / 2.99792458e8 * 1e26), 6) AS jy FROM s GROUP BY 1"


def source_stellar_template(spark: SparkSession, sf: str) -> DataFrame:
    make = lambda v: ("nu,fnu\n" + "".join(f"{(i + 1) * 1e12!r},{x!r}\n" for i, x in enumerate(v.tolist()))).encode()
    out = tables.read_stellar_template(spark, _vectors_as_files(spark, sf, make))
    return out.groupBy(_id()).agg(F.round(F.sum(F.col("fnu") / F.col("wavelength")), 6).alias("moment"), F.round(F.max("wavelength"), 6).alias("longest"))


SOURCE_STELLAR_TEMPLATE = f"WITH {SPECTRA_SQL} SELECT vec_id, round(sum(y * (k + 1) * 1e12 / 2.99792458e14), 6) AS moment, 299.792458::DOUBLE AS longest FROM s GROUP BY 1"


def run_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A run saved with its settings and read again."""
    path = scratch(spark, "run")
    chains = table(spark, sf, "events").select(F.col("user_id").alias("walker"), F.col("event_id").alias("step"), F.array("value").alias("theta"), (-F.col("value")).alias("lnprob"))
    tables.write_run(chains, path, {"walkers": 7, "name": "line"})
    back, settings = tables.read_run(spark, path)
    return back.groupBy("walker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("theta")[0]), 6).alias("total"), F.round(F.max("lnprob"), 6).alias("best")).withColumn("name", F.lit(settings["name"]))


RUN_ROUND_TRIP = "SELECT user_id AS walker, count(*) AS n, round(sum(value), 6) AS total, round(max(-value), 6) AS best, 'line' AS name FROM events GROUP BY 1"


def vega_zero_points(spark: SparkSession, sf: str) -> DataFrame:
    """Zero points of bands from a star's curve: here a power law, sampled on the bands' grid."""
    from spectrail.plans.observations import _filters

    star = spark.range(1, 65).select(F.lit(0).alias("star"), F.col("id").cast("double").alias("wavelength"), (3600.0 * F.pow(F.col("id").cast("double"), F.lit(-1.9))).alias("flux"))
    zero = integrate.zero_points(star, _filters(spark))
    mags = table(spark, sf, "part").select(F.concat(F.lit("photon"), (F.col("p_partkey") % 4).cast("string")).alias("filter"), (F.col("p_size") / 10).alias("mag"))
    flux, _ = units.magnitude_to_jy(F.col("mag"), F.lit(0.1), F.col("zero_point"))
    return mags.join(F.broadcast(zero), "filter").groupBy("filter").agg(F.round(F.max("zero_point"), 6).alias("zero_point"), F.round(F.avg(flux), 6).alias("jy"))


def _vega_sql() -> str:
    from spectrail.plans.observations import FILTERS_SQL

    return f"""
WITH {FILTERS_SQL}, v AS (SELECT filter, x, m, 3600.0 * pow(x, -1.9) AS v FROM f),
a AS (SELECT filter, 0.5 * (m * v / (x * x) + lead(m * v / (x * x)) OVER w) * (lead(x) OVER w - x) AS a, 0.5 * (m / (x * x) + lead(m / (x * x)) OVER w) * (lead(x) OVER w - x) AS c FROM v WINDOW w AS (PARTITION BY filter ORDER BY x)),
z AS (SELECT filter, sum(a) / sum(c) AS z FROM a GROUP BY 1)
SELECT filter, round(z, 6) AS zero_point, round(avg(z * pow(10, -0.4 * p_size / 10)), 6) AS jy FROM part JOIN z ON filter = 'photon' || (p_partkey % 4) GROUP BY filter, z
"""


VEGA_ZERO_POINTS = _vega_sql()

def source_image(spark: SparkSession, sf: str) -> DataFrame:
    """Images of eight by eight pixels."""
    out = tables.read_image(spark, _vectors_as_files(spark, sf, lambda v: writers.fits_image(v.reshape(8, 8))))
    return out.groupBy(_id()).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * (8 * F.col("y") + F.col("x") + 1)), 6).alias("moment"))


SOURCE_IMAGE = f"WITH {SPECTRA_SQL} SELECT vec_id, count(*) AS n, round(sum(y * (k + 1)), 6) AS moment FROM s GROUP BY 1"


def alma_filter_file(spark: SparkSession, sf: str) -> DataFrame:
    """Generated curves written in the two-header layout and read as filters."""
    path = scratch(spark, "alma")
    tables.write_filter_csv(tables.alma_band(spark, [(84.0, 116.0), (125.0, 163.0)]), path, "photon", "um")
    return tables.read_filter_csv(spark, path).select("detector", F.round("wavelength", 6).alias("wavelength"), "transmission")


ALMA_FILTER_FILE = """
WITH f AS (SELECT 0.95::DOUBLE * 84 + (1.05::DOUBLE * 163 - 0.95::DOUBLE * 84) / 199 * i AS f FROM range(200) r(i))
SELECT 'photon' AS detector, round(2.99792458e14 / (f * 1e9), 6) AS wavelength, CASE WHEN (f > 84 AND f < 116) OR (f > 125 AND f < 163) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS transmission FROM f
"""


def transfer_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A program's output in falling wavelengths, brought to a fixed grid that reaches beyond it."""
    make = lambda v: "\n".join(["1 1.0e-12 3", *(f"  {64 - i} {abs(x) + 1!r}" for i, x in enumerate(v.tolist())), ""]).encode()
    seen = tables.read_radiative_transfer(spark, _vectors_as_files(spark, sf, make)).select(_id(), F.col("wavelength").alias("x"), (F.col("flux") / F.col("wavelength")).alias("y"))
    grid = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("j")).select("vec_id", "j", (0.3 + 4.3 * F.col("j")).alias("x"))
    return align.interpolate(seen, grid, ["vec_id"], "x", "y", "clamp").select("vec_id", "j", F.round("y", 6).alias("y"))


TRANSFER_ON_GRID = """
WITH b AS (SELECT vec_id, embedding AS e, CAST(j AS INT) AS j, least(greatest(0.3::DOUBLE + 4.3::DOUBLE * j, 1), 64) AS x FROM embeddings, range(17) r(j)),
k AS (SELECT *, CAST(least(floor(x), 63) AS INT) AS k FROM b), y AS (SELECT vec_id, j, x - k AS d, abs(e[65 - k]::DOUBLE) + 1 AS l, abs(e[64 - k]::DOUBLE) + 1 AS h FROM k)
SELECT vec_id, j, round((l + d * (h - l)) * 1e-12 * 1e-6 / 2.99792458e8 * 1e26, 6) AS y FROM y
"""


def filters_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Curves on a coarser grid, and their pivots there."""
    curves = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("filter"), F.lit("photon").alias("detector"), F.posexplode("embedding").alias("k", "t"))
    curves = curves.select("filter", "detector", (10.0 + F.col("k")).alias("wavelength"), F.abs("t").cast("double").alias("transmission"))
    grid = spark.range(30).select((5.5 + 3.0 * F.col("id")).alias("wavelength"))
    moved = integrate.filters_on_grid(curves, grid)
    pivots = integrate.pivot_wavelength(moved)
    return moved.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("transmission"), 6).alias("total")).join(pivots, "filter").select("filter", "n", "total", F.round("lpivot", 6).alias("lpivot"))


FILTERS_ON_GRID = """
WITH g AS (SELECT vec_id, embedding AS e, 5.5::DOUBLE + 3.0 * i AS x FROM embeddings, range(30) r(i)), k AS (SELECT *, CAST(floor(x) AS INT) - 9 AS k, x - floor(x) AS d FROM g),
t AS (SELECT vec_id, x, CASE WHEN x >= 10 AND x <= 73 THEN abs(e[k]::DOUBLE) + d * (abs(e[least(k + 1, 64)]::DOUBLE) - abs(e[k]::DOUBLE)) ELSE 0.0::DOUBLE END AS t FROM k),
a AS (SELECT vec_id, t, 0.5 * (x * t + lead(x * t) OVER w) * (lead(x) OVER w - x) AS b, 0.5 * (t / x + lead(t / x) OVER w) * (lead(x) OVER w - x) AS c FROM t WINDOW w AS (PARTITION BY vec_id ORDER BY x))
SELECT CAST(vec_id AS VARCHAR) AS filter, count(*) AS n, round(sum(t), 6) AS total, round(sqrt(sum(b) / sum(c)), 6) AS lpivot FROM a GROUP BY 1
"""


def density_shell(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("r"))
    return rows.select("p_partkey", F.round(integrate.power_law_shell(F.col("r"), F.lit(5.0), F.lit(40.0), 1.5, F.lit(2.0)), 8).alias("density"))


DENSITY_SHELL = "SELECT p_partkey, round(CASE WHEN p_size BETWEEN 5 AND 40 THEN 2 * pow(p_size / 5.0::DOUBLE, -1.5) ELSE 0 END, 8) AS density FROM part"


def nested_report(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence, information and effective samples of weighted events."""
    rows = table(spark, sf, "events").select("event_type", (F.col("value") / 20).alias("logl"), (F.col("value") / 20 - F.col("event_id") / 1000.0).alias("logwt"))
    out = diagnostics.nested_summary(rows, ["event_type"], "logwt", "logl", 50)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("logz", "information", "logz_error", "effective")])


NESTED_REPORT = """
WITH w AS (SELECT event_type, value / 20 AS logl, value / 20 - event_id / 1000.0::DOUBLE AS logwt FROM events), m AS (SELECT event_type, max(logwt) AS m FROM w GROUP BY 1),
z AS (SELECT event_type, any_value(m) + ln(sum(exp(logwt - m))) AS z FROM w JOIN m USING (event_type) GROUP BY 1),
h AS (SELECT event_type, z, sum(exp(logwt - z) * (logl - z)) AS h, pow(sum(exp(logwt - z)), 2) / sum(pow(exp(logwt - z), 2)) AS n FROM w JOIN z USING (event_type) GROUP BY event_type, z)
SELECT event_type, round(z, 6) AS logz, round(h, 6) AS information, round(sqrt(greatest(h, 0) / 50), 6) AS logz_error, round(n, 6) AS effective FROM h
"""

DECK = {
    "geometry": ("Spherical", {"illumination": decks.illumination("sphere", central=True)}), "spectrum": ("BB", {"count": 1, "temperatures": decks.VARIABLE}), "scale": ("tin", {"temperature": decks.VARIABLE}),
    "grains": ("common", {"abundances": [0.5, 0, 0, 0, 0.5, 0]}), "sizes": ("modified_mrn", {"power": 3.5, "min": 0.005, "max": 0.25}), "sublimation": ("temperature", {"temperature": 1500}),
    "density": ("powerlaw", {"count": 1, "radii": [1000], "powers": [2]}), "tau": ("log", {"wavelength": 0.55, "min": 0.1, "max": 10, "models": 5}), "accuracy": ("flux", {"percent": 5}),
}


def transfer_decks(spark: SparkSession, sf: str) -> DataFrame:
    """A deck for each part, with its own star and inner edge."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    text = decks.deck(DECK, {"spectrum.temperatures": F.col("p_size") * 100 + 2000, "scale.temperature": F.col("p_size") + 800})
    return rows.select("p_partkey", text.alias("deck"))


TRANSFER_DECKS = """
SELECT p_partkey, concat_ws(chr(10), 'geometry = SPHERE', 'central = ON', 'external = OFF', 'spectral shape = BLACK_BODY', 'Number of BB = 1', 'Temperatures = ' || (p_size * 100 + 2000) || ' K', 'Scale: type of entry = T1', 'Td = ' || (p_size + 800) || ' K',
  'optical properties index = COMMON_GRAIN_COMPOSITE', 'Abundances for supported grain types:', 'Sil-Ow  Sil-Oc  Sil-DL  grf-DL  amC-Hn  SiC-Pg', 'x = 0.5, 0, 0, 0, 0.5, 0', 'Size distribution = MODIFIED_MRN', 'q = 3.5', 'a(min) = 0.005 micron', 'a(max) = 0.25 micron',
  'Sublimation Temperature = 1500 K', 'density type = POWD', 'N = 1', 'transition radii = 1000', 'power indices = 2', 'grid type = LOGARITHMIC', 'lambda0 = 0.55 micron', 'tau(min) = 0.1', 'tau(max) = 10', 'number of models = 5', 'accuracy for flux conservation = 5', '') AS deck
FROM part
"""

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "source_votable", "source_votable_spectrum", "source_spitzer_low", "source_spitzer_high", "source_fits_table", "source_sws", "source_lrs", "source_user_text",
    "source_opacities", "source_opacity_list", "source_filters", "source_eso_filters", "source_filter_library", "source_radiative_transfer", "source_stellar_template",
    "run_round_trip", "vega_zero_points", "transfer_decks",
    "source_image", "alma_filter_file", "transfer_on_grid", "filters_on_grid", "density_shell", "nested_report",
)}
