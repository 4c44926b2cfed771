"""Units at ingest: everything becomes µm and Jy as Column arithmetic, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C_UM = 2.99792458e14  # µm / s
H_EV = 4.135667696e-15  # eV s
POGSON = 0.4
POGSON_COMPAT = 100 ** (-1 / 5)

#: Lengths in µm; frequencies in Hz; energies in eV.
LENGTHS = {"um": 1.0, "micron": 1.0, "nm": 1e-3, "angstrom": 1e-4, "mm": 1e3, "cm": 1e4, "m": 1e6}
FREQUENCIES = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9, "thz": 1e12}
ENERGIES = {"ev": 1.0, "kev": 1e3}
#: Flux densities per frequency in Jy.
PER_FREQUENCY = {"jy": 1.0, "mjy": 1e-3, "ujy": 1e-6, "w/m2/hz": 1e26, "erg/s/cm2/hz": 1e23}
#: Flux densities per wavelength, as Jy at 1 µm; they grow with the wavelength squared.
PER_WAVELENGTH = {"w/m2/um": 1e26 / C_UM, "erg/s/cm2/angstrom": 1e23 * 1e4 / C_UM, "erg/s/cm2/um": 1e23 / C_UM}
#: Power per area, as Jy at 1 µm; they grow with the wavelength.
POWERS = {"w/m2": 1e26 / C_UM, "erg/s/cm2": 1e23 / C_UM}


def _table(unit: Column, factors: dict[str, float]) -> Column:
    """The unit's factor, or null."""
    pairs = [x for k, v in factors.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.try_element_at(F.create_map(*pairs), F.lower(unit))


def unknown_unit(unit: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {what} unit: "), F.coalesce(unit, F.lit("none")))).cast("double")


def to_um(value: Column, unit: Column) -> Column:
    """Wavelength in µm from a length, frequency or photon energy; a missing or unknown unit fails the job."""
    frequency, energy = _table(unit, FREQUENCIES), _table(unit, ENERGIES)
    return F.coalesce(
        value * _table(unit, LENGTHS),
        F.try_divide(F.lit(C_UM), value * frequency),
        F.try_divide(F.lit(C_UM * H_EV), value * energy),
        F.when(value.isNotNull() & (F.coalesce(_table(unit, LENGTHS), frequency, energy).isNull()), unknown_unit(unit, "wavelength")),
    )


def to_jy(value: Column, unit: Column, wavelength_um: Column) -> Column:
    """Flux density in Jy at a wavelength; a missing or unknown unit fails the job."""
    w = wavelength_um
    factor = F.coalesce(_table(unit, PER_FREQUENCY), _table(unit, PER_WAVELENGTH) * w * w, _table(unit, POWERS) * w)
    known = F.coalesce(_table(unit, PER_FREQUENCY), _table(unit, PER_WAVELENGTH), _table(unit, POWERS))
    return F.coalesce(value * factor, F.when(value.isNotNull() & known.isNull(), unknown_unit(unit, "flux")))


def magnitude_to_jy(magnitude: Column, error: Column, zero_jy: Column, exponent: float = POGSON) -> tuple[Column, Column]:
    """Flux and symmetric error: the mean of the upper and lower error, which is F sinh(k sigma ln 10)."""
    flux = zero_jy * F.pow(F.lit(10.0), -exponent * magnitude)
    up, down = F.pow(F.lit(10.0), exponent * error), F.pow(F.lit(10.0), -exponent * error)
    return flux, 0.5 * flux * ((1 - down) + (up - 1))


def magnitude_error(flux: float, sigma: float, exponent: float = POGSON) -> float:
    return flux * math.sinh(exponent * sigma * math.log(10))
