"""Masks, cleaning, names, chunks and blocks of observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVALS = ("closed", "left-open", "right-open", "open")


def in_interval(x: Column, low: float = 0.0, high: float = float("inf"), interval: str = "closed") -> Column:
    """low and high inside or outside, by the kind of interval. As a filter it reaches the Parquet scan."""
    if interval not in INTERVALS:
        raise ValueError(f"interval is one of {INTERVALS}, not {interval!r}")
    lower = x > low if interval in ("left-open", "open") else x >= low
    upper = x < high if interval in ("right-open", "open") else x <= high
    return lower & upper


def select_waves(df: DataFrame, low: float = 0.0, high: float = float("inf"), interval: str = "closed", wavelength: str = "wavelength", mask: str = "mask") -> DataFrame:
    """AND the interval onto the mask; without a mask column all rows count as unmasked before."""
    before = F.col(mask) if mask in df.columns else F.lit(True)
    return df.withColumn(mask, before & in_interval(F.col(wavelength), low, high, interval))


def unmask(df: DataFrame, mask: str = "mask") -> DataFrame:
    return df.withColumn(mask, F.lit(True))


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows without null, NaN or infinity in any floating column and without null in any other numeric one."""
    keep = F.lit(True)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            keep = keep & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        elif isinstance(f.dataType, T.NumericType):
            keep = keep & F.col(f.name).isNotNull()
    return df.where(keep)


def filter_name(name: Column) -> Column:
    """A library's spelling of a filter name. Every rule looks at what the rules before it made."""
    plain = F.replace(F.replace(F.replace(name, F.lit(":"), F.lit("_")), F.lit("/"), F.lit("_")), F.lit("WISE"), F.lit("WISE_RSR"))
    return F.replace(F.replace(plain, F.lit("Spitzer"), F.lit("SPITZER")), F.lit("RSR_RSR"), F.lit("RSR"))


def match_filters(observed: DataFrame, library: DataFrame, name: str = "filter") -> tuple[DataFrame, DataFrame]:
    """Observations whose filter the library has, and those to warn of."""
    known = library.select(name).distinct()
    return observed.join(known, name, "left_semi"), observed.join(known, name, "left_anti")


def datasets_of_chunks(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Number chunks 1, 2, ... in order; a table without chunks is one dataset.

    Only the distinct chunks are ranked and joined back: no window sees all rows.
    """
    if chunk not in df.columns:
        return df.withColumn("dataset_id", F.lit(1))
    ranks = df.select(F.col(chunk).alias("_chunk")).distinct().withColumn("dataset_id", F.dense_rank().over(W.orderBy("_chunk")))
    return df.join(ranks, F.col(chunk).eqNullSafe(F.col("_chunk"))).drop("_chunk")


def gap_split(df: DataFrame, keys: list[str], x: str, order: list[str], gap: float, chunk: str = "chunk") -> DataFrame:
    """Chunk 1 up to each key's first jump of x by more than `gap`, chunk 2 behind it; without a jump all is chunk 1."""
    w = W.partitionBy(*keys).orderBy(*order)
    jump = F.col(x) - F.lag(x).over(w) > gap
    return df.withColumn(chunk, F.when(F.max(F.coalesce(jump, F.lit(False))).over(w.rowsBetween(W.unboundedPreceding, 0)), 2).otherwise(1))


def stack_blocks(*blocks: DataFrame, tag: str = "module") -> DataFrame:
    """UNION ALL with the block's number."""
    out = blocks[0].withColumn(tag, F.lit(1))
    for i, block in enumerate(blocks[1:], 2):
        out = out.unionByName(block.withColumn(tag, F.lit(i)))
    return out


def spitzer_chunks(module: Column) -> Column:
    """Short-low modules 0 and 1 are chunk 1, long-low modules 2 and 3 chunk 2."""
    return F.when(module.isin(0, 1), 1).when(module.isin(2, 3), 2)


def pretty_rows(df: DataFrame, columns: list[str], mask: str = "mask") -> DataFrame:
    """Unmasked rows with numbers printed in two digits; what lies halfway is rounded up."""
    return df.where(F.col(mask)).select(*[F.format_string("%.2e", F.col(c).cast("double")).alias(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in columns])


def first_of_each(df: DataFrame, name: str, order: str) -> DataFrame:
    """One row of each name, the first by `order`."""
    rest = [c for c in df.columns if c != name]
    first = F.min_by(F.struct(*rest), order)
    return df.groupBy(name).agg(first.alias("row")).select(name, *[F.col("row")[c].alias(c) for c in rest])


def rest_frame(wavelength: Column, redshift: Column) -> Column:
    """The wavelength at which light seen at `wavelength` was sent."""
    return wavelength / (1 + redshift)


def fields(df: DataFrame) -> DataFrame:
    """What every dataset has: wavelength, value, uncertainty and mask (all points if it has none)."""
    mask = F.col("mask") if "mask" in df.columns else F.lit(True)
    return df.select("wavelength", "value", "uncertainty", mask.alias("mask"))
