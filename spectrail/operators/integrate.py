"""Integrals and sums along the wavelength axis, and generated grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrail.operators.align import interpolate

DETECTORS = ("photon", "energy")


def trapezoids(x: Column, y: Column, w) -> Column:
    """The area from each row to the next one; null at the last."""
    return 0.5 * (y + F.lead(y).over(w)) * (F.lead(x).over(w) - x)


def trapz(df: DataFrame, keys: list[str], x: str, y: str, out: str = "integral", order: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*(order or [x]))
    return df.withColumn("_a", trapezoids(F.col(x), F.col(y), w)).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(out))


def array_trapz(x: Column, y: Column) -> Column:
    """The same of two array columns, without a shuffle."""
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    n = F.size(x)
    left, right = F.slice(pairs, 1, F.greatest(n - 1, F.lit(0))), F.slice(pairs, 2, F.greatest(n - 1, F.lit(0)))
    areas = F.zip_with(left, right, lambda a, b: 0.5 * (a["y"] + b["y"]) * (b["x"] - a["x"]))
    return F.when(n > 1, F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)).otherwise(F.lit(0.0))


def weighted(detector: Column, x: Column, transmission: Column) -> Column:
    """The weight of a wavelength in a band mean: photon counters see x T, energy counters T."""
    return F.when(detector == "photon", x * transmission).otherwise(transmission)


def pivot_wavelength(filters: DataFrame, name: str = "filter") -> DataFrame:
    """Per filter sqrt(I1/I2); I2 has the weight over x squared."""
    w = W.partitionBy(name).orderBy("wavelength")
    weight = weighted(F.col("detector"), F.col("wavelength"), F.col("transmission"))
    top = trapezoids(F.col("wavelength"), weight, w)
    low = trapezoids(F.col("wavelength"), weight / (F.col("wavelength") * F.col("wavelength")), w)
    return filters.select(name, top.alias("a"), low.alias("b")).groupBy(name).agg(F.sqrt(F.sum("a") / F.sum("b")).alias("lpivot"))


def band_fluxes(flux: DataFrame, filters: DataFrame, keys: list[str], grid: str = "wavelength") -> DataFrame:
    """Synthetic photometry of F_nu on filters given on the same grid: the band mean of F_nu / x^2, times the pivot squared."""
    f = filters.select("filter", "detector", F.col("wavelength").alias(grid), "transmission")
    joined = flux.select(*keys, grid, "flux").join(f, grid)
    w = W.partitionBy(*keys, "filter").orderBy(grid)
    x = F.col(grid)
    weight = weighted(F.col("detector"), x, F.col("transmission"))
    areas = joined.select(*keys, "filter", trapezoids(x, weight * F.col("flux") / (x * x), w).alias("a"), trapezoids(x, weight, w).alias("b"), trapezoids(x, weight / (x * x), w).alias("c"))
    sums = areas.groupBy(*keys, "filter").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    # mean times pivot squared = (a / b) (b / c)
    return sums.select(*keys, "filter", F.sqrt(F.try_divide(F.col("b"), F.col("c"))).alias("lpivot"), F.try_divide("a", "c").alias("flux"))


def filters_on_grid(filters: DataFrame, grid: DataFrame) -> DataFrame:
    """Filter curves at the wavelengths of a grid, zero outside each band: what synthetic photometry takes. `grid` is of a bounded size."""
    bands = filters.select("filter", "detector").distinct()
    wanted = bands.crossJoin(F.broadcast(grid.select("wavelength")))
    moved = interpolate(filters.select("filter", "wavelength", "transmission"), wanted, ["filter"], "wavelength", "transmission", "null")
    return moved.withColumn("transmission", F.coalesce("transmission", F.lit(0.0)))


def power_law_shell(radius: Column, inner: Column, outer: Column, power: float, density: Column) -> Column:
    """Density that falls as a power of the radius from its value at the inner edge, and is zero outside both edges."""
    return F.when((radius >= inner) & (radius <= outer), density * F.pow(radius / inner, F.lit(-float(power)))).otherwise(0.0)


def zero_points(star: DataFrame, filters: DataFrame, grid: str = "wavelength") -> DataFrame:
    """Each filter's flux of magnitude zero in Jy: the band flux of the standard star's curve on the filters' grid."""
    return band_fluxes(star.withColumn("_star", F.lit(0)), filters, ["_star"], grid).select("filter", "lpivot", F.col("flux").alias("zero_point"))


def opacity_in_cm(opacity: Column, species_idx: Column, scales: dict[int, float]) -> Column:
    """Opacities without negative values, in the library's unit: species listed in `scales` are multiplied by their factor."""
    q = F.greatest(opacity, F.lit(0.0))
    for i, scale in scales.items():
        q = F.when(species_idx == i, F.greatest(opacity, F.lit(0.0)) * scale).otherwise(q)
    return q


def mix(opacities: Column, abundances: Column) -> Column:
    """Matrix times vector at one grid point: the sum of opacity times abundance."""
    return F.aggregate(F.zip_with(opacities, abundances, lambda q, a: q * a), F.lit(0.0), lambda s, v: s + v)


def grid(spark: SparkSession, low: float, high: float, points: int, spacing: str = "linear") -> DataFrame:
    """grid_idx from 0 and wavelength, evenly spaced linearly, in log10, or in 1/x (ascending)."""
    i, last = F.col("id"), max(points - 1, 1)
    if spacing == "linear":
        x = low + (high - low) / last * i
    elif spacing == "log":
        x = F.pow(F.lit(10.0), F.log10(F.lit(low)) + (F.log10(F.lit(high)) - F.log10(F.lit(low))) / last * i)
    elif spacing == "reciprocal":
        x = 1 / (1 / high + (1 / low - 1 / high) / last * (last - i))
    else:
        raise ValueError(f"no spacing {spacing!r}")
    return spark.range(points).select(i.cast("int").alias("grid_idx"), x.alias("wavelength"))


def resolution_grid(spark: SparkSession, low: float, high: float, resolution: float) -> DataFrame:
    """A geometric grid with x / dx = resolution."""
    import math

    points = int(math.log(high / low) / math.log1p(1 / resolution)) + 1
    return spark.range(points).select(F.col("id").cast("int").alias("grid_idx"), (low * F.pow(F.lit(1 + 1 / resolution), F.col("id"))).alias("wavelength"))


def size_distribution(spark: SparkSession, low: float, high: float, points: int, power: float, turn: float) -> DataFrame:
    """Grain sizes and a^power exp(-a / turn), scaled to sum to one."""
    a = grid(spark, low, high, points).select(F.col("wavelength").alias("size_um"))
    n = a.withColumn("number", F.pow("size_um", F.lit(power)) * F.exp(-F.col("size_um") / turn))
    return n.crossJoin(F.broadcast(n.agg(F.sum("number").alias("_all")))).select("size_um", (F.col("number") / F.col("_all")).alias("number"))
