"""Readers of observation, filter and opacity files, each with a fixed schema.

A source is a path, or a table of files that are at hand already (path, content).
Line-based formats go through `spark.read.text`, self-contained ones (VOTable, FITS)
through `binaryFile`, one file a row, parsed on the executors. Lines are numbered,
and a file read whole for that, only where a format goes by their order.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrail.functions import units
from spectrail.operators.select import finite_rows, gap_split, spitzer_chunks

C_UM_HZ = units.C_UM


Source = str | DataFrame


def _files(spark: SparkSession, source: Source) -> DataFrame:
    """path, content."""
    files = spark.read.format("binaryFile").load(source) if isinstance(source, str) else source
    return files.select("path", "content")


def _lines(spark: SparkSession, source: Source) -> DataFrame:
    """file, line number within its file from 1, text."""
    lines = F.split(F.col("content").cast("string"), r"\r?\n")
    return _files(spark, source).select(F.col("path").alias("file"), F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _loose_lines(spark: SparkSession, source: Source) -> DataFrame:
    """file, text; a large file is split over tasks."""
    if isinstance(source, str):
        return spark.read.text(source).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return _lines(spark, source).drop("line")


def _fields(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def read_columns(spark: SparkSession, path: Source, names: list[str], comment: str = "#") -> DataFrame:
    """White-space separated numbers; lines that start otherwise than with a number are headers or comments."""
    number = r"^\s*[-+]?(\d|\.\d)"
    rows = _loose_lines(spark, path).where(~F.col("text").startswith(comment) & F.col("text").rlike(number))
    parts = _fields(F.col("text"))
    return rows.select("file", *[F.try_element_at(parts, F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)])


def read_opacities(spark: SparkSession, path: Source, value: str = "q") -> DataFrame:
    """species (the file's name without its ending), species_idx in name order, wavelength, q; `sub` files have the continuum-subtracted q second."""
    rows = read_columns(spark, path, ["wavelength", value])
    species = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(_sub)?\.[^.]*$", "")
    named = rows.select(species.alias("species"), "wavelength", value)
    order = named.select("species").distinct().withColumn("species_idx", (F.dense_rank().over(W.orderBy("species")) - 1).cast("int"))
    return named.join(F.broadcast(order), "species").select("species", "species_idx", "wavelength", value)


def read_opacity_list(spark: SparkSession, list_path: Source, folder: Source) -> DataFrame:
    """The same in the order of a list file; the order is what unit fixes go by."""
    names = _lines(spark, list_path).select(F.trim("text").alias("name"), "line").where("name <> ''")
    order = names.select("name", (F.row_number().over(W.orderBy("line")) - 1).cast("int").alias("species_idx"))
    rows = read_columns(spark, f"{folder.rstrip('/')}/*" if isinstance(folder, str) else folder, ["wavelength", "q"]).withColumn("name", F.element_at(F.split("file", "/"), -1))
    return rows.join(F.broadcast(order), "name").select(F.col("name").alias("species"), "species_idx", "wavelength", "q")


def read_user_text(spark: SparkSession, path: str, wavelength: str, flux: str, uncertainty: str | None, wavelength_unit: str, flux_unit: str, header: bool = True, separator: str = ",") -> DataFrame:
    """A delimited file with the user's names; µm and Jy come out. Without an uncertainty the likelihood has none either, so that it must be named."""
    if uncertainty is None:
        raise ValueError("name the uncertainty column: a zero uncertainty makes the covariance singular")
    raw = spark.read.option("header", header).option("sep", separator).option("inferSchema", False).csv(path)
    x, y, e = (F.col(f"`{c}`").cast("double") for c in (wavelength, flux, uncertainty))
    w = units.to_um(x, F.lit(wavelength_unit))
    f = F.lit(flux_unit)
    out = raw.select(w.alias("wavelength"), units.to_jy(y, f, w).alias("value"), units.to_jy(e, f, w).alias("uncertainty"), *([F.col("chunk").cast("int")] if "chunk" in raw.columns else []))
    return out if "chunk" in raw.columns else out.withColumn("chunk", F.lit(1))


def read_lrs(spark: SparkSession, path: Source) -> DataFrame:
    """A name line, then two blocks of wavelength and power per area, parted by a dashed line; flux in Jy, no uncertainty."""
    rows = _lines(spark, path)
    dash = F.col("text").rlike(r"^\s*-{5,}\s*$")
    module = 1 + F.sum(dash.cast("int")).over(W.partitionBy("file").orderBy("line"))
    numbers = rows.withColumn("module", module).where(~dash & F.col("text").rlike(r"^\s*[-+]?(\d|\.\d)"))
    parts = _fields(F.col("text"))
    w, power = parts[0].cast("double"), F.try_element_at(parts, F.lit(2)).cast("double")
    return numbers.select("file", F.col("module").cast("int"), w.alias("wavelength"), units.to_jy(power, F.lit("W/m2"), w).alias("value"))


def read_filter_csv(spark: SparkSession, path: Source) -> DataFrame:
    """Two-header filter files: names; unit and detector; then wavelength and transmission."""
    rows = _lines(spark, path).where(F.trim("text") != "").where(~F.col("text").startswith("#"))
    place = F.row_number().over(W.partitionBy("file").orderBy("line"))
    parts = F.split("text", ",")
    numbered = rows.withColumn("n", place)
    second = numbered.where("n = 2").select("file", F.lower(F.trim(parts[0])).alias("unit"), F.lower(F.trim(parts[1])).alias("detector"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    x = parts[0].cast("double")
    values = numbered.where("n > 2").select("file", "line", x.alias("x"), parts[1].cast("double").alias("transmission"))
    return values.join(second, "file").select(name.alias("filter"), "detector", units.to_um(F.col("x"), F.col("unit")).alias("wavelength"), "transmission")


def read_eso_filter(spark: SparkSession, path: Source) -> DataFrame:
    """Wavelength, transmission and, if there, its error."""
    return read_columns(spark, path, ["wavelength", "transmission", "error"])


def write_filter_csv(filters: DataFrame, path: str, detector: str, unit: str) -> None:
    """The two-header layout, as one file: a filter is a few thousand lines."""
    head = filters.sparkSession.createDataFrame([(-2, "wavelength,transmission"), (-1, f"{unit},{detector}")], "n int, value string")
    body = filters.select(F.row_number().over(W.orderBy("wavelength")).alias("n"), F.format_string("%s,%s", F.col("wavelength").cast("string"), F.col("transmission").cast("string")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def write_filter_library(filters: DataFrame, path: str) -> None:
    """Each filter once, the first detector and grid of a name by detector order; Parquet."""
    first = filters.groupBy("filter").agg(F.min("detector").alias("detector"))
    filters.join(first, ["filter", "detector"]).dropDuplicates(["filter", "wavelength"]).write.mode("overwrite").parquet(path)


def alma_band(spark: SparkSession, windows: list[tuple[float, float]], points: int = 200) -> DataFrame:
    """frequency_ghz from 0.95 of the least to 1.05 of the greatest, wavelength in µm and 1 inside any open window; ascending in wavelength."""
    low, high = 0.95 * min(a for a, _ in windows), 1.05 * max(b for _, b in windows)
    f = low + (high - low) / (points - 1) * F.col("id")
    inside = F.exists(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in windows]), lambda w: (F.col("frequency_ghz") > w["a"]) & (F.col("frequency_ghz") < w["b"]))
    return spark.range(points).select(f.alias("frequency_ghz")).select("frequency_ghz", (C_UM_HZ / (F.col("frequency_ghz") * 1e9)).alias("wavelength"), F.when(inside, 1.0).otherwise(0.0).alias("transmission")).orderBy("wavelength")


def _votable_rows(raw: bytes) -> Iterator[dict]:
    root = ET.fromstring(raw)
    strip = lambda tag: tag.rsplit("}", 1)[-1]
    for table in (e for e in root.iter() if strip(e.tag) == "TABLE"):
        fields = [e for e in table if strip(e.tag) == "FIELD"]
        for tr in (e for e in table.iter() if strip(e.tag) == "TR"):
            row = {}
            for field, td in zip(fields, (e for e in tr if strip(e.tag) == "TD"), strict=True):
                text, kind, size = (td.text or "").strip(), field.get("datatype", ""), field.get("arraysize")
                if "char" in kind.lower():
                    row[field.get("name")] = text
                elif size and size != "1":
                    row[field.get("name")] = [float(x) for x in text.split()]
                else:
                    row[field.get("name")] = float(text) if text else math.nan
                row[f"{field.get('name')}.unit"] = field.get("unit")
            yield row


def read_votable_photometry(spark: SparkSession, path: Source) -> DataFrame:
    """filter, flux, err and unit of the columns sed_filter, sed_flux and sed_eflux, empty cells null; one file a row until parsed."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for name, raw in zip(b["path"], b["content"], strict=True):
                rows = [(name, r["sed_filter"], r["sed_flux"], r["sed_eflux"], r["sed_flux.unit"]) for r in _votable_rows(raw)]
                yield pd.DataFrame(rows, columns=["file", "filter", "flux", "err", "unit"])

    return _files(spark, path).mapInPandas(parse, "file string, filter string, flux double, err double, unit string")


def read_votable_spectrum(spark: SparkSession, path: Source, wavelength: str, flux: str) -> DataFrame:
    """Array cells as rows: file, wavelength, flux and frequency for wavelengths in µm."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for name, raw in zip(b["path"], b["content"], strict=True):
                for r in _votable_rows(raw):
                    yield pd.DataFrame({"file": name, "wavelength": r[wavelength], "flux": r[flux]})

    rows = _files(spark, path).mapInPandas(parse, "file string, wavelength double, flux double")
    return rows.withColumn("nu", C_UM_HZ / F.col("wavelength"))


#: Fixed values of the FITS standard: bytes of a block, of a card, and NumPy's names of its types.
FITS_BLOCK, FITS_CARD = 2880, 80
FITS_IMAGE = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
FITS_TABLE = {"L": "S1", "B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def fits_units(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header and data of each header-data unit."""
    at = 0
    while at + FITS_BLOCK <= len(raw):
        header: dict = {}
        ended = False
        while not ended and at + FITS_BLOCK <= len(raw):
            block = raw[at : at + FITS_BLOCK].decode("ascii", "replace")
            at += FITS_BLOCK
            for i in range(0, FITS_BLOCK, FITS_CARD):
                card = block[i : i + FITS_CARD]
                key = card[:8].strip()
                if key == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    value = card[10:]
                    quoted = re.match(r"\s*'((?:[^']|'')*)'", value)
                    if quoted:
                        header[key] = quoted[1].replace("''", "'").rstrip()
                    else:
                        word = value.split("/")[0].strip()
                        header[key] = word == "T" if word in ("T", "F") else float(word.replace("D", "E")) if re.search(r"[.ED]", word) else int(word) if word else None
        axes = [header.get(f"NAXIS{i + 1}", 0) for i in range(header.get("NAXIS", 0))]
        size = abs(header.get("BITPIX", 8)) // 8 * (int(np.prod(axes)) if axes else 0) + header.get("PCOUNT", 0)
        yield header, raw[at : at + size]
        at += -(-size // FITS_BLOCK) * FITS_BLOCK


def fits_image(raw: bytes, unit: int = 0) -> tuple[dict, np.ndarray]:
    header, data = list(fits_units(raw))[unit]
    shape = tuple(header[f"NAXIS{i + 1}"] for i in reversed(range(header["NAXIS"])))
    values = np.frombuffer(data, FITS_IMAGE[header["BITPIX"]]).reshape(shape).astype(float)
    return header, values * header.get("BSCALE", 1.0) + header.get("BZERO", 0.0)


def fits_table(raw: bytes, unit: int = 1, names: list[str] | None = None) -> pd.DataFrame:
    """A binary table, its columns named by the file or, in order, by `names`."""
    header, data = list(fits_units(raw))[unit]
    kinds = []
    for i in range(header["TFIELDS"]):
        count, code = re.match(r"(\d*)([A-Z])", header[f"TFORM{i + 1}"]).groups()
        n = int(count or 1)
        kinds.append((names[i] if names else header.get(f"TTYPE{i + 1}", f"col{i + 1}"), f"S{n}" if code == "A" else FITS_TABLE[code], () if code == "A" or n == 1 else (n,)))
    rows = np.frombuffer(data[: header["NAXIS1"] * header["NAXIS2"]], np.dtype(kinds))
    plain = {}
    for name, _, shape in kinds:
        column = rows[name]
        plain[name] = [c.decode().strip() for c in column] if column.dtype.kind == "S" else list(column.astype(column.dtype.newbyteorder("="))) if shape else column.astype(column.dtype.newbyteorder("="))
    return pd.DataFrame(plain)


def _parse_files(spark: SparkSession, path: Source, parse, schema: str) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for name, raw in zip(b["path"], b["content"], strict=True):
                out = parse(raw)
                out.insert(0, "file", name)
                yield out

    return _files(spark, path).mapInPandas(run, schema)


def read_spitzer_low(spark: SparkSession, path: Source) -> DataFrame:
    """Low-resolution spectra: an image of 16 columns named in the header; finite rows, modules as chunks, in wavelength order."""

    def parse(raw: bytes) -> pd.DataFrame:
        header, image = fits_image(raw)
        names = [str(header.get(f"COL{i + 1:02d}DEF", "DUMMY")).strip() for i in range(image.shape[1] - 1)] + ["DUMMY"]
        found = {n: image[:, i] for i, n in reversed(list(enumerate(names)))}
        return pd.DataFrame({"wavelength": found["wavelength"], "value": found["flux"], "uncertainty": found["error (RMS+SYS)"], "module": found["module"], "others": list(image)})

    rows = _parse_files(spark, path, parse, "file string, wavelength double, value double, uncertainty double, module double, others array<double>")
    fine = finite_rows(rows).where(F.forall("others", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return fine.select("file", "wavelength", "value", "uncertainty", spitzer_chunks(F.col("module").cast("int")).alias("chunk")).orderBy("file", "wavelength")


def read_spitzer_high(spark: SparkSession, path: Source) -> DataFrame:
    """High-resolution spectra: per order 11 to 20 the first jump of more than 5 µm parts chunks 1 and 2; other orders are chunk 0."""

    def parse(raw: bytes) -> pd.DataFrame:
        header, image = fits_image(raw)
        names = [str(header.get(f"COL{i + 1:02d}DEF", "DUMMY")).strip() for i in range(image.shape[1])]
        found = {n: image[:, i] for i, n in reversed(list(enumerate(names)))}
        return pd.DataFrame({"idx": np.arange(len(image)), "wavelength": found["wavelength"], "value": found["flux"], "uncertainty": found["flux_error"], "irs_order": found["IRS_order"].astype(int)})

    rows = finite_rows(_parse_files(spark, path, parse, "file string, idx long, wavelength double, value double, uncertainty double, irs_order long"))
    split = gap_split(rows, ["file", "irs_order"], "wavelength", ["idx"], 5.0)
    return split.withColumn("chunk", F.when(F.col("irs_order").between(11, 20), F.col("chunk")).otherwise(0)).orderBy("file", "wavelength")


def read_image(spark: SparkSession, path: Source, unit: int = 0) -> DataFrame:
    """Pixels of FITS images: file, y, x (from 0) and value; a cube's planes lie one behind the other in y."""

    def parse(raw: bytes) -> pd.DataFrame:
        _, image = fits_image(raw, unit)
        flat = image.reshape(-1, image.shape[-1])
        y, x = np.indices(flat.shape)
        return pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "value": flat.ravel()})

    return _parse_files(spark, path, parse, "file string, y long, x long, value double")


def read_fits_spectrum(spark: SparkSession, path: Source, wavelength: str, flux: str, uncertainty: str, wavelength_unit: str = "um", flux_unit: str = "Jy", unit: int = 1) -> DataFrame:
    """A binary table with the user's column names; one chunk."""

    def parse(raw: bytes) -> pd.DataFrame:
        t = fits_table(raw, unit)
        return pd.DataFrame({"x": t[wavelength].astype(float), "y": t[flux].astype(float), "e": t[uncertainty].astype(float)})

    rows = _parse_files(spark, path, parse, "file string, x double, y double, e double")
    w, u = units.to_um(F.col("x"), F.lit(wavelength_unit)), F.lit(flux_unit)
    return rows.select("file", w.alias("wavelength"), units.to_jy(F.col("y"), u, w).alias("value"), units.to_jy(F.col("e"), u, w).alias("uncertainty"), F.lit(1).alias("chunk"))


#: Fixed values of the format: the columns of an SWS table, in order, whatever the file calls them.
SWS_COLUMNS = ["wavelength", "flux", "uncertainty", "integration count", "detector number", "time key", "universal time key", "rpid", "spare", "line number", "scan direction", "counts", "status", "flag"]


def read_sws(spark: SparkSession, path: Source) -> DataFrame:
    """A binary table of 14 columns that go by their places; µm and Jy."""
    rows = _parse_files(spark, path, lambda raw: fits_table(raw, 1, SWS_COLUMNS)[SWS_COLUMNS[:3]].astype(float), "file string, wavelength double, flux double, uncertainty double")
    return rows.select("file", "wavelength", F.col("flux").alias("value"), "uncertainty", F.lit(1).alias("chunk"))


SPECTRUM_FORMATS = {"SPITZER-YAAAR": read_spitzer_low, "SPITZER-YAAAR_OPTDIFFHR": read_spitzer_high, "IRAS-LRS": read_lrs, "SWS-AAR": read_sws}


def read_radiative_transfer(spark: SparkSession, path: Source) -> DataFrame:
    """A code's output: in its first line the scale in W/m2 second, then wavelength and relative flux; Jy."""
    rows = _lines(spark, path).where(F.trim("text") != "").withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("line")))
    number = lambda i: F.try_element_at(_fields(F.col("text")), F.lit(i)).cast("double")
    scale = rows.where("n = 1").select("file", number(2).alias("scale"))
    values = rows.where("n > 1").select("file", number(1).alias("wavelength"), number(2).alias("relative"))
    w = F.col("wavelength")
    return values.join(scale, "file").select("file", "wavelength", units.to_jy(F.col("relative") * F.col("scale"), F.lit("W/m2"), w).alias("flux"))


def read_stellar_template(spark: SparkSession, path: Source) -> DataFrame:
    """Lines of frequency and flux under one line of names; wavelengths in µm, ascending within a file."""
    parts = F.split("text", ",")
    rows = _loose_lines(spark, path).where(F.col("text").rlike(r"^\s*[-+]?(\d|\.\d)"))
    return rows.select("file", parts[0].cast("double").alias("nu"), parts[1].cast("double").alias("fnu")).withColumn("wavelength", C_UM_HZ / F.col("nu")).orderBy("file", "wavelength")


def read_filter_library(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """filter, detector, wavelength, transmission of a library that `write_filter_library` wrote; of the filters named, if any are."""
    filters = spark.read.parquet(path)
    return filters if wanted is None else filters.where(F.col("filter").isin(wanted))


def read_spectrum(spark: SparkSession, path: Source, format: str, filetype: str | None = None, **options) -> DataFrame:
    """By format tag; User-Defined takes the column names as options."""
    if format in SPECTRUM_FORMATS:
        return SPECTRUM_FORMATS[format](spark, path)
    if format == "User-Defined" and filetype == "fits":
        return read_fits_spectrum(spark, path, **options)
    if format == "User-Defined" and filetype == "text":
        return read_user_text(spark, path, **options)
    raise ValueError(f"no spectrum format {format!r} of file type {filetype!r}")


def write_run(chains: DataFrame, path: str, metadata: dict) -> None:
    """A run as Parquet beside its metadata as one JSON line."""
    import json

    chains.write.mode("overwrite").parquet(f"{path}/chains")
    chains.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    import json

    return spark.read.parquet(f"{path}/chains"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, thread, level and message of a text log."""
    pattern = r"^(\S+ \S+)\s+\[([^\]]*)\]\s+\[([^\]]*)\]\s+(.*)$"
    field = lambda i: F.trim(F.regexp_extract("value", pattern, i))
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(F.try_to_timestamp(F.replace(field(1), F.lit(","), F.lit("."))).alias("ts"), field(2).alias("thread"), field(3).alias("level"), field(4).alias("message"))
