"""An addition: photometry that arrives as files, normalised and masked as it comes.

Each row stands alone, so that the stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from spectrail.functions import units
from spectrail.operators import select

SCHEMA = "object_id long, filter string, wavelength double, wavelength_unit string, value double, uncertainty double, flux_unit string"


def stream_photometry(spark: SparkSession, path: str, low: float = 0.0, high: float = float("inf"), interval: str = "closed") -> DataFrame:
    """Rows of JSON files in µm and Jy, with a mask by wavelength. Rows with a null or non-finite number are left out."""
    raw = select.finite_rows(spark.readStream.schema(SCHEMA).json(path))
    w, unit = units.to_um(F.col("wavelength"), F.col("wavelength_unit")), F.col("flux_unit")
    rows = raw.select("object_id", select.filter_name(F.col("filter")).alias("filter"), w.alias("wavelength"), units.to_jy(F.col("value"), unit, w).alias("value"), units.to_jy(F.col("uncertainty"), unit, w).alias("uncertainty"))
    return select.select_waves(rows, low, high, interval)


def write_observations(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table until everything there is has been taken."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
