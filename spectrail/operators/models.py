"""Emission and extinction models: Columns over wavelength and parameters, with NumPy twins.

A model maps a wavelength in µm and named parameters to a flux. `flux` builds the
Column; `flux_np` evaluates rows of parameters on a grid as one matrix. Models with
species take the opacities of a grid point as an array and abundances as another.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions import physics
from spectrail.operators.integrate import mix


class ModelSpec(Protocol):
    """What a user's model has to offer."""

    labels: tuple[str, ...]

    def flux(self, wavelength: Column, theta: Sequence[Column]) -> Column: ...

    def flux_np(self, wavelength: np.ndarray, theta: np.ndarray) -> np.ndarray: ...


def _ten(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


@dataclass(frozen=True)
class StraightLine:
    labels: tuple[str, ...] = ("slope", "intercept")

    def flux(self, wavelength: Column, theta: Sequence[Column]) -> Column:
        return theta[0] * wavelength + theta[1]

    def flux_np(self, wavelength: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return theta[:, :1] * wavelength + theta[:, 1:2]


@dataclass(frozen=True)
class ModifiedBlackbody:
    """B(T) 10^log_mass Msun kappa (x / x0)^beta / (distance pc)^2, in Jy."""

    kappa: float = 0.1  # m2 / kg
    reference_um: float = 850.0
    labels: tuple[str, ...] = ("temperature", "log_mass", "beta", "distance_pc")

    def flux(self, wavelength: Column, theta: Sequence[Column]) -> Column:
        t, mass, beta, d = theta
        area = d * physics.PARSEC
        return physics.planck_jy(wavelength, t) / (area * area) * _ten(mass) * physics.SOLAR_MASS * self.kappa * F.pow(wavelength / self.reference_um, beta)

    def flux_np(self, wavelength: np.ndarray, theta: np.ndarray) -> np.ndarray:
        t, mass, beta, d = (theta[:, i : i + 1] for i in range(4))
        return physics.planck_jy_np(wavelength, t) / (d * physics.PARSEC) ** 2 * 10**mass * physics.SOLAR_MASS * self.kappa * (wavelength / self.reference_um) ** beta


@dataclass(frozen=True)
class ScaledBlackbody:
    """B(T) 10^scale (x / x0)^index / distance^2 times sigma0; a redshift moves to the rest frame and sets the distance."""

    sigma0: float = 1.0
    reference_um: float = 1.0
    redshift: float | None = None
    labels: tuple[str, ...] = ("temperature", "scale", "index", "distance")

    def flux(self, wavelength: Column, theta: Sequence[Column]) -> Column:
        t, scale, index, d = theta
        x = wavelength
        if self.redshift is not None:
            x, d = x / (1 + self.redshift), F.lit(float(physics.luminosity_distance_mpc_np(np.array([self.redshift]))[0]))
        return physics.planck_jy(x, t) / (d * d) * _ten(scale) * self.sigma0 * F.pow(x / self.reference_um, index)

    def flux_np(self, wavelength: np.ndarray, theta: np.ndarray) -> np.ndarray:
        t, scale, index, d = (theta[:, i : i + 1] for i in range(4))
        x = wavelength
        if self.redshift is not None:
            x, d = x / (1 + self.redshift), physics.luminosity_distance_mpc_np(np.array([self.redshift]))[0]
        return physics.planck_jy_np(x, t) / d**2 * 10**scale * self.sigma0 * (x / self.reference_um) ** index


def power_law_absolute(wavelength: Column, index: Column, opacities: Column, log_abundances: Column) -> Column:
    """x^index (1 + sum of q 10^a)."""
    return F.pow(wavelength, index) * (1 + mix(opacities, F.transform(log_abundances, _ten)))


def power_law_relative(wavelength: Column, multiplier: Column, index: Column, opacities: Column, abundances: Column) -> Column:
    """10^multiplier x^index (1 + sum of q w); n fractions w, or the logarithms of the first n - 1 of them."""
    logs = F.transform(abundances, _ten)
    rest = 1 - F.aggregate(logs, F.lit(0.0), lambda s, w: s + w)
    weights = F.when(F.size(abundances) == F.size(opacities), abundances).otherwise(F.concat(logs, F.array(rest)))
    return _ten(multiplier) * F.pow(wavelength, index) * (1 + mix(opacities, weights))


def dual_temperature(wavelength: Column, features: Sequence[Column], continuum: Sequence[Column], opacities: Column, log_abundances: Column) -> Column:
    """(sum of q 10^a) (f1 B(T1) + f2 B(T2)) + c1 B(U1) + c2 B(U2); features and continuum are (T1, T2, f1, f2)."""

    def two(p: Sequence[Column]) -> Column:
        return p[2] * physics.planck_jy(wavelength, p[0]) + p[3] * physics.planck_jy(wavelength, p[1])

    return mix(opacities, F.transform(log_abundances, _ten)) * two(features) + two(continuum)


def screened_log_polynomial(wavelength: Column, a: Column, b: Column, c: Column, opacities: Column, abundances: Column) -> Column:
    """exp(a ln^2 x + b ln x + c - sum of q w)."""
    x = F.ln(wavelength)
    return F.exp(a * x * x + b * x + c - mix(opacities, abundances))


def screened_polynomial(wavelength: Column, a: Column, b: Column, c: Column, opacities: Column, abundances: Column) -> Column:
    """(a x^2 + b x + c) exp(-sum of q w)."""
    return (a * wavelength * wavelength + b * wavelength + c) * F.exp(-mix(opacities, abundances))


def truncated_disc(wavelength: Column, temperature: Column, scale: Column, edge: Column, beta: Column) -> Column:
    """10^scale B(T), falling as (edge / x)^beta from the edge on."""
    return _ten(scale) * physics.planck_jy(wavelength, temperature) * F.when(wavelength >= edge, F.pow(edge / wavelength, beta)).otherwise(1.0)


def template_star(params: DataFrame, templates: DataFrame, keys: list[str], temperature: str, step: float, on: Sequence[str] = ("wavelength",)) -> DataFrame:
    """A star's flux between the templates (temperature, `on`, flux) next below and above its temperature, on their grid.

    Templates stand every `step` kelvins; two equi-joins find them. Outside their range there is no row.
    """
    below = F.floor(F.col(temperature) / step) * step
    asked = params.select(*keys, F.col(temperature).alias("_t"), below.cast("double").alias("_low"))
    low = templates.select(F.col("temperature").cast("double").alias("_low"), *on, F.col("flux").alias("_a"))
    high = templates.select((F.col("temperature") - step).cast("double").alias("_low"), *on, F.col("flux").alias("_b"))
    part = (F.col("_t") - F.col("_low")) / step
    # At a template's own temperature the next one isn't needed.
    return asked.join(low, "_low").join(high, ["_low", *on], "left").withColumn("flux", F.when(part == 0, F.col("_a")).otherwise(F.col("_a") + part * (F.col("_b") - F.col("_a")))).where("flux IS NOT NULL").select(*keys, *on, "flux")


@dataclass(frozen=True)
class DustShell:
    """A dust shell between two temperatures, summed over steps - 1 layers."""

    steps: int = 15
    density_power: float = 0.5
    temperature_power: float = 0.5
    grain_cm: float = 1e-5
    inner_cm: float = 1e15
    density: float = 1.0
    distance_pc: float = 910.0

    def _factor(self) -> float:
        d = self.distance_pc * physics.PARSEC * 100
        return 4 * math.pi * self.grain_cm**2 * self.inner_cm**3 * self.density / ((3 - self.density_power) * d * d)

    def flux(self, wavelength: Column, inner: Column, outer: Column, opacity: Column) -> Column:
        width = (inner - outer) / self.steps
        slope = -(3 - self.density_power) / self.temperature_power

        def layer(j: int) -> Column:
            t = inner - j * width
            return physics.shell_planck(wavelength, t) * F.pow(t / inner, F.lit(slope))

        # Written out: a higher-order function is interpreted row by row, a sum is compiled.
        total = functools.reduce(operator.add, map(layer, range(self.steps - 1)))
        return self._factor() * opacity * width * total

    def flux_np(self, wavelength: np.ndarray, inner: float, outer: float, opacity: np.ndarray) -> np.ndarray:
        width = (inner - outer) / self.steps
        t = inner - np.arange(self.steps - 1)[:, None] * width
        slope = -(3 - self.density_power) / self.temperature_power
        return self._factor() * (opacity * physics.shell_planck_np(wavelength, t) * (t / inner) ** slope * width).sum(axis=0)


#: The optical/near-infrared polynomials of Cardelli, Clayton & Mathis (1989), in y = x - 1.82 from y^0 on.
CCM_A = (1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.77530, 0.32999)
CCM_B = (0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.30260, -2.09002)


def ccm_coefficients(x: Column) -> tuple[Column, Column]:
    """a(x) and b(x) of the same law for x in 1/µm from 0.3 to 10; null outside."""

    def poly(c: Sequence[float], y: Column) -> Column:
        out = F.lit(c[-1])
        for v in reversed(c[:-1]):
            out = out * y + v
        return out

    y, z, f = x - 1.82, x - 5.9, x - 8
    bump = x >= 5.9
    fa = F.when(bump, -0.04473 * z * z - 0.009779 * z * z * z).otherwise(0.0)
    fb = F.when(bump, 0.2130 * z * z + 0.1207 * z * z * z).otherwise(0.0)
    p, q = x - 4.67, x - 4.62
    a = (
        F.when((x >= 0.3) & (x < 1.1), 0.574 * F.pow(x, F.lit(1.61)))
        .when((x >= 1.1) & (x < 3.3), poly(CCM_A, y))
        .when((x >= 3.3) & (x < 8), 1.752 - 0.316 * x - 0.104 / (p * p + 0.341) + fa)
        .when((x >= 8) & (x <= 10), poly((-1.073, -0.628, 0.137, -0.070), f))
    )
    b = (
        F.when((x >= 0.3) & (x < 1.1), -0.527 * F.pow(x, F.lit(1.61)))
        .when((x >= 1.1) & (x < 3.3), poly(CCM_B, y))
        .when((x >= 3.3) & (x < 8), -3.090 + 1.825 * x + 1.206 / (q * q + 0.263) + fb)
        .when((x >= 8) & (x <= 10), poly((13.670, 4.257, -0.420, 0.374), f))
    )
    return a, b


def ccm_extinction(wavelength: Column, a_v: Column, r_v: Column) -> Column:
    """The factor by which light is dimmed."""
    a, b = ccm_coefficients(1 / wavelength)
    return F.pow(F.lit(10.0), -0.4 * (a + b / r_v) * a_v)


#: Fixed values of Fitzpatrick (1999): spline anchors in 1/µm with A(x)/E(B-V) at R = 3.1 below the ultraviolet.
F99_ANCHORS = (0.0, 1e4 / 26500, 1e4 / 12200, 1e4 / 6000, 1e4 / 5470, 1e4 / 4670, 1e4 / 4110)
F99_INFRARED = (0.0, 0.26469, 0.82925)
#: Powers of R_V from 0 on, at 6000, 5470, 4670 and 4110 angstrom.
F99_OPTICAL = (
    (-4.22809e-01, 1.00270, 2.13572e-04),
    (-5.13540e-02, 1.00216, -7.35778e-05),
    (7.00127e-01, 1.00184, -3.32598e-05),
    (1.19456, 1.01707, -5.46959e-03, 7.97809e-04, -4.45636e-05),
)
F99_C3, F99_C4, F99_X0, F99_GAMMA = 3.23, 0.41, 4.596, 0.99


def _f99_ultraviolet(x: np.ndarray, r_v: float) -> np.ndarray:
    c2 = -0.824 + 4.717 / r_v
    c1 = 2.030 - 3.007 * c2
    drude = x * x / ((x * x - F99_X0**2) ** 2 + (x * F99_GAMMA) ** 2)
    far = np.where(x > 5.9, 0.5392 * (x - 5.9) ** 2 + 0.05644 * (x - 5.9) ** 3, 0.0)
    return c1 + c2 * x + F99_C3 * drude + F99_C4 * far + r_v


def _spline_system(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices m, r with m k = r y for the second derivatives k of the natural spline through (x, y)."""
    n, h = len(x), np.diff(x)
    m, r = np.eye(n), np.zeros((n, n))
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    return m, r


def _natural_spline(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    n, h = len(x), np.diff(x)
    m, r = _spline_system(x)
    k = np.linalg.solve(m, r @ y)

    def at(v: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(x, v, side="right") - 1, 0, n - 2)
        a, b = x[i + 1] - v, v - x[i]
        return (k[i] * a**3 + k[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - k[i] * h[i] / 6) * a + (y[i + 1] / h[i] - k[i + 1] * h[i] / 6) * b

    return at


def f99_curve(wavelength_um: np.ndarray, r_v: float = 3.1) -> np.ndarray:
    """A(x) / A(V)."""
    x = 1 / np.asarray(wavelength_um, dtype=float)
    optical = np.array([np.polyval(c[::-1], r_v) for c in F99_OPTICAL])
    infrared = np.array(F99_INFRARED) * r_v / 3.1
    ends = np.array([1e4 / 2700, 1e4 / 2600])
    spline = _natural_spline(np.concatenate([F99_ANCHORS, ends]), np.concatenate([infrared, optical, _f99_ultraviolet(ends, r_v)]))
    return np.where(x >= 1e4 / 2700, _f99_ultraviolet(x, r_v), spline(x)) / r_v


@dataclass(frozen=True)
class F99Extinction:
    """The dimming factor with A_V and R_V each fixed, or taken from theta in that order."""

    a_v: float | None = None
    r_v: float | None = None

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(n for n, v in (("a_v", self.a_v), ("r_v", self.r_v)) if v is None)

    def factor_np(self, wavelength: np.ndarray, theta: np.ndarray) -> np.ndarray:
        free = list(np.asarray(theta, dtype=float).T)
        a_v = self.a_v if self.a_v is not None else free.pop(0)
        r_v = self.r_v if self.r_v is not None else free.pop(0)
        a_v, r_v = np.broadcast_arrays(np.atleast_1d(a_v), np.atleast_1d(r_v))
        curves = {r: f99_curve(wavelength, float(r)) for r in np.unique(r_v)}
        return 10 ** (-0.4 * a_v[:, None] * np.array([curves[r] for r in r_v]))


    def factor(self, wavelength: Column, theta: Sequence[Column] = ()) -> Column:
        """The same as a Column."""
        free = list(theta)
        a_v = F.lit(float(self.a_v)) if self.a_v is not None else free.pop(0)
        r_v = F.lit(float(self.r_v)) if self.r_v is not None else free.pop(0)
        return F.pow(F.lit(10.0), -0.4 * a_v * f99_column(wavelength, r_v))

    def lnprior(self, theta: Sequence[Column], a_v_limits: tuple[float, float] = (0.0, 10.0), r_v_limits: tuple[float, float] = (2.0, 6.0)) -> Column:
        """0 where what is free lies within its closed limits, else -Infinity; 0 if nothing is free."""
        limits = [x for x, v in ((a_v_limits, self.a_v), (r_v_limits, self.r_v)) if v is None]
        inside = F.lit(True)
        for x, (low, high) in zip(theta, limits, strict=True):
            inside = inside & x.between(low, high)
        return F.when(inside, F.lit(0.0)).otherwise(F.lit(float("-inf")))

    def transform(self, u: Sequence[Column], a_v_limits: tuple[float, float] = (0.0, 10.0), r_v_limits: tuple[float, float] = (2.0, 6.0)) -> list[Column]:
        """Uniforms to what is free."""
        limits = [x for x, v in ((a_v_limits, self.a_v), (r_v_limits, self.r_v)) if v is None]
        return [low + (high - low) * x for x, (low, high) in zip(u, limits, strict=True)]


def f99_column(wavelength: Column, r_v: Column) -> Column:
    """A(x) / A(V) with R_V a Column: a natural spline is linear in its anchors' values, and those are polynomials in R_V."""
    ends = (1e4 / 2700, 1e4 / 2600)
    anchors = np.array([*F99_ANCHORS, *ends])
    bends = np.linalg.solve(*_spline_system(anchors))  # second derivatives for a unit value at each anchor
    polynomial = lambda c: sum((v * F.pow(r_v, F.lit(float(i))) for i, v in enumerate(c)), F.lit(0.0))
    c2 = -0.824 + 4.717 / r_v
    c1 = 2.030 - 3.007 * c2

    def ultraviolet(x):
        square = lambda v: v * v
        far = (F.when(x > 5.9, x - 5.9).otherwise(F.lit(0.0))) if isinstance(x, Column) else max(x - 5.9, 0.0)
        return c1 + c2 * x + F99_C3 * (x * x / (square(x * x - F99_X0**2) + square(x * F99_GAMMA))) + F99_C4 * (0.5392 * far * far + 0.05644 * far * far * far) + r_v

    values = [v * r_v / 3.1 for v in F99_INFRARED] + [polynomial(c) for c in F99_OPTICAL] + [ultraviolet(v) for v in ends]
    x = 1 / wavelength
    curve = ultraviolet(x)
    for i in reversed(range(len(anchors) - 2)):
        low, high = float(anchors[i]), float(anchors[i + 1])
        h, a, b = high - low, high - x, x - low
        bend = lambda k: sum((float(bends[k, j]) * values[j] for j in range(len(values)) if bends[k, j]), F.lit(0.0))
        left, right = bend(i), bend(i + 1)
        piece = (left * a * a * a + right * b * b * b) / (6 * h) + (values[i] / h - left * h / 6) * a + (values[i + 1] / h - right * h / 6) * b
        curve = F.when(x < high, piece).otherwise(curve)
    return curve / r_v


OPERATORS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}


def combine(left: DataFrame, right: DataFrame, op: str, keys: list[str], flux: str = "flux") -> DataFrame:
    """Two models' fluxes on one grid, by an equi-join; division by zero is null."""
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}")
    # Spark doesn't count the rows that a grid adds to each parameter row, and would broadcast them all.
    joined = left.select(*keys, F.col(flux).alias("_a")).hint("merge").join(right.select(*keys, F.col(flux).alias("_b")), keys)
    value = F.try_divide("_a", "_b") if op == "/" else OPERATORS[op](F.col("_a"), F.col("_b"))
    return joined.select(*keys, value.alias(flux))


@dataclass(frozen=True)
class Composite:
    """Two models as one: parameters of the first, then of the second."""

    first: ModelSpec
    second: ModelSpec
    op: str

    @property
    def labels(self) -> tuple[str, ...]:
        return (*self.first.labels, *self.second.labels)

    def flux(self, wavelength: Column, theta: Sequence[Column]) -> Column:
        n = len(self.first.labels)
        return OPERATORS[self.op](self.first.flux(wavelength, theta[:n]), self.second.flux(wavelength, theta[n:]))

    def flux_np(self, wavelength: np.ndarray, theta: np.ndarray) -> np.ndarray:
        n = len(self.first.labels)
        return OPERATORS[self.op](self.first.flux_np(wavelength, theta[:, :n]), self.second.flux_np(wavelength, theta[:, n:]))


def evaluate(params: DataFrame, grid: DataFrame, model: ModelSpec, theta: str = "theta") -> DataFrame:
    """model_flux of every parameter row on every grid point. The grid is the small, bounded side."""
    columns = [F.col(theta)[i] for i in range(len(model.labels))]
    return params.crossJoin(F.broadcast(grid.select("grid_idx", "wavelength"))).withColumn("flux", model.flux(F.col("wavelength"), columns))


def dust_mass(number_density: Column, grain_cm: Column, grain_density: Column, inner_cm: Column, inner: Column, outer: Column, density_power: float = 0.5, temperature_power: float = 0.5) -> Column:
    """A shell's dust in solar masses; its width follows from the fall of temperature from inner to outer."""
    grain = 4 / 3 * math.pi * F.pow(grain_cm, F.lit(3.0)) * grain_density
    volume = math.pi * F.pow(inner_cm, F.lit(3.0)) / (3 - density_power) * (F.pow(outer / inner, F.lit(-2.0 / temperature_power)) - 1)
    return volume * grain * number_density / (1e3 * physics.SOLAR_MASS)


def calibrated_radius(mass: float, inner: float, outer: float, number_density: float, grain_cm: float, grain_density: float, new_inner: float, density_power: float = 0.5, temperature_power: float = 0.5) -> float:
    """The inner radius at which a known solution has its mass, moved to another inner temperature."""
    grain = 4 / 3 * math.pi * grain_cm**3 * grain_density
    cubed = mass * 1e3 * physics.SOLAR_MASS / (math.pi / (3 - density_power) * ((outer / inner) ** (-2 / temperature_power) - 1) * grain * number_density)
    return cubed ** (1 / 3) * (new_inner / inner) ** (-1 / temperature_power)
