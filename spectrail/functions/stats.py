"""Densities and inverse distribution functions as Columns, with log 0 = -Infinity throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def safe_ln(x: Column) -> Column:
    """ln with -Infinity at or below zero and where x is null or NaN."""
    return F.when((x > 0) & ~F.isnan(x), F.ln(x)).otherwise(F.lit(NEG_INF))


def no_nan(x: Column) -> Column:
    """NaN and null read as -Infinity, so that no maximum or sort puts them first."""
    return F.when(x.isNull() | F.isnan(x), F.lit(NEG_INF)).otherwise(x)


def normal_lnpdf(x: Column, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - math.log(sd) - HALF_LN_2PI


def half_normal_lnpdf(x: Column, scale: float) -> Column:
    return F.when(x >= 0, 0.5 * math.log(2 / math.pi) - math.log(scale) - x * x / (2 * scale * scale)).otherwise(F.lit(NEG_INF))


def uniform_lnpdf(x: Column, low: float, high: float) -> Column:
    return F.when((x >= low) & (x <= high), F.lit(-math.log(high - low))).otherwise(F.lit(NEG_INF))


#: Acklam's rational approximation to the normal quantile (relative error below 1.2e-9).
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ACKLAM_EDGE = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def probit(u: Column) -> Column:
    """The normal quantile; infinite at 0 and 1, null outside."""
    tail = F.sqrt(-2 * F.ln(F.when(u < 0.5, u).otherwise(1 - u)))
    edge = _horner(ACKLAM_C, tail) / _horner(ACKLAM_D, tail)
    q = u - 0.5
    middle = _horner(ACKLAM_A, q * q) * q / _horner(ACKLAM_B, q * q)
    return (
        F.when((u < 0) | (u > 1), F.lit(None).cast("double"))
        .when(u == 0, F.lit(NEG_INF))
        .when(u == 1, F.lit(-NEG_INF))
        .when(u < ACKLAM_EDGE, edge)
        .when(u > 1 - ACKLAM_EDGE, -edge)
        .otherwise(middle)
    )


def half_normal_ppf(u: Column, scale: float) -> Column:
    return scale * probit((1 + u) / 2)


def log_sum_exp(x: Column, top: Column) -> Column:
    """An aggregate over rows that each hold the maximum of x as `top`."""
    return F.first(top) + F.ln(F.sum(F.exp(x - top)))


def keyed_uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash of keys: the same on any partitioning, unlike rand()."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 12).cast("double") + 0.5) / float(1 << 52)


def box_muller(u1: Column, u2: Column) -> Column:
    """A normal deviate from two uniforms."""
    return F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)


def keyed_normal(*keys: Column) -> Column:
    """A normal deviate from two keyed uniforms."""
    return box_muller(keyed_uniform(*keys, F.lit(1)), keyed_uniform(*keys, F.lit(2)))
