"""Input decks of a radiative-transfer program: options checked, and the deck's text as a Column.

A deck has blocks; each block has kinds, of which one is chosen by any of its names, and
a kind has fields. A field is a value, or `VARIABLE`: then each row of parameters brings
its own, so that one set of options makes a deck a row.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIABLE = "variable"


@dataclass(frozen=True)
class Kind:
    """One choice in a block: its names, its first line, and its fields with the lines that they stand in."""

    names: tuple[str, ...]
    head: str
    fields: tuple[tuple[str, str], ...] = ()


_TAU = (("wavelength", "lambda0 = {} micron"), ("min", "tau(min) = {}"), ("max", "tau(max) = {}"), ("models", "number of models = {}"))
_ABUNDANCES = "Abundances for supported grain types:\nSil-Ow  Sil-Oc  Sil-DL  grf-DL  amC-Hn  SiC-Pg"

#: Fixed values of the deck's format: blocks in their order, names that a kind goes by, and the lines that the program reads.
BLOCKS: dict[str, tuple[Kind, ...]] = {
    "geometry": (
        Kind(("sphere", "spherical"), "geometry = SPHERE", (("illumination", "{}"),)),
        Kind(("sphere_matrix",), "geometry = SPHERE_MATRIX", (("illumination", "{}"),)),
        Kind(("slab", "plane parallel"), "geometry = SLAB", (("illumination", "{}"),)),
    ),
    "spectrum": (
        Kind(("blackbody", "black body", "black-body", "black_body", "bb"), "spectral shape = BLACK_BODY", (("count", "Number of BB = {}"), ("temperatures", "Temperatures = {} K"))),
        Kind(("engelke",), "spectral shape = ENGELKE_MARENGO", (("temperature", "Temperature = {} K"), ("sio_depth", "SiO absorption depth = {} percents"))),
        Kind(("powerlaw", "power-law"), "spectral shape = POWERLAW", (("count", "N = {}"), ("wavelengths", "lambda = {} micron"), ("powers", "k = {}"))),
        Kind(("file_lambda_f_lambda",), "spectral shape = FILE_LAMBDA_F_LAMBDA", (("file", "filename = {}"),)),
        Kind(("file_f_lambda",), "spectral shape = FILE_F_LAMBDA", (("file", "filename = {}"),)),
        Kind(("file_f_nu",), "spectral shape = FILE_F_NU", (("file", "filename = {}"),)),
    ),
    "scale": (
        Kind(("flux",), "Scale: type of entry = FLUX", (("flux", "Fe = {} W/m^2"),)),
        Kind(("luminosity",), "Scale: type of entry = LUM_R1", (("luminosity", "L = {} % in L_sun"), ("distance", "d = {} cm"))),
        Kind(("energy-density", "energy density"), "Scale: type of entry = ENERGY_DEN", (("energy_density", "J = {} W/m^2"),)),
        Kind(("dilution-factor", "dilution_factor", "dilution factor"), "Scale: type of entry = DILUTN_FAC", (("dilution", "W = {}"),)),
        Kind(("inner-temperature", "inner temperature", "tin"), "Scale: type of entry = T1", (("temperature", "Td = {} K"),)),
    ),
    "grains": (
        Kind(("common", "common_grain_composite", "common grain composite"), f"optical properties index = COMMON_GRAIN_COMPOSITE\n{_ABUNDANCES}", (("abundances", "x = {}"),)),
        Kind(
            ("common and additional", "common_and_addl_grain", "common and addl grain"), f"optical properties index = COMMON_AND_ADDL_GRAIN\n{_ABUNDANCES}",
            (("abundances", "x = {}\nNumber of additional components = 3, properties listed in files\namC-zb1.nk\namC-zb2.nk\namC-zb3.nk"), ("additional", "Abundances for these components = {}")),
        ),
        Kind(("tabulated",), "optical properties index = TABULATED", (("file", "X-sections input file = {}"),)),
    ),
    "sizes": (
        Kind(("mrn",), "Size distribution = MRN"),
        Kind(("modified mrn", "modified_mrn"), "Size distribution = MODIFIED_MRN", (("power", "q = {}"), ("min", "a(min) = {} micron"), ("max", "a(max) = {} micron"))),
        Kind(("kmh",), "Size distribution = KMH", (("power", "q = {}"), ("min", "a(min) = {} micron"), ("typical", "a0 = {} micron"))),
    ),
    "sublimation": (Kind(("temperature",), "", (("temperature", "Sublimation Temperature = {} K"),)),),
    "density": (
        Kind(("powerlaw", "power-law"), "density type = POWD", (("count", "N = {}"), ("radii", "transition radii = {}"), ("powers", "power indices = {}"))),
        Kind(("exponential", "exp"), "density type = EXPD", (("outer", "Y = {}"), ("falloff", "sigma = {}"))),
        Kind(("radiation driven wind", "rdw"), "density type = RDW", (("outer", "Y = {}"),)),
        Kind(("radiation driven wind analytic", "rdwa"), "density type = RDWA", (("outer", "Y = {}"),)),
        Kind(("user supplied", "user-supplied"), "density type = USR_SUPPLD", (("file", "profile filename = {}"),)),
    ),
    "tau": (
        Kind(("linear", "lin"), "grid type = LINEAR", _TAU),
        Kind(("logarithmic", "log"), "grid type = LOGARITHMIC", _TAU),
        Kind(("user supplied", "user-supplied", "user_supplied"), "grid type = USER_SUPPLIED", (("file", "tau values filename = {}"),)),
    ),
    "accuracy": (Kind(("flux",), "", (("percent", "accuracy for flux conservation = {}"),)),),
}
CENTRAL, EXTERNAL = "central = ON\nexternal = OFF", "central = OFF\nexternal = ON"
STEEPEST = 85.0


def illumination(geometry: str, central: bool = False, external: bool = False, angle: float | None = None) -> str:
    """How the dust is lit: a sphere from its centre or from outside, a slab from all sides (no angle) or at an angle."""
    if geometry in BLOCKS["geometry"][2].names:
        if angle is None:
            return "angular distribution = ISOTROPIC"
        if angle > STEEPEST:
            raise ValueError(f"illumination at {angle} degrees is beyond {STEEPEST}")
        return f"angular distribution = DIRECTIONAL\nillumination angle = {angle} degrees"
    if central == external:
        raise ValueError("a sphere is lit from its centre or from outside, not both and not neither")
    return CENTRAL if central else EXTERNAL


def choose(block: str, name: str) -> Kind:
    """The kind that goes by a name, whatever its case."""
    for kind in BLOCKS[block]:
        if name.lower() in kind.names:
            return kind
    raise ValueError(f"{block} must be one of {', '.join(k.names[0] for k in BLOCKS[block])}, not {name!r}")


def check(options: Mapping[str, tuple[str, Mapping[str, object]]]) -> dict[str, tuple[Kind, dict[str, object]]]:
    """Options (block: kind's name and its fields) with each kind found and no field missing or unknown."""
    unknown = options.keys() - BLOCKS.keys()
    if unknown or options.keys() != BLOCKS.keys():
        raise ValueError(f"blocks unknown: {sorted(unknown)}, missing: {sorted(BLOCKS.keys() - options.keys())}")
    out = {}
    for block in BLOCKS:
        name, given = options[block]
        kind = choose(block, name)
        wanted = {f for f, _ in kind.fields}
        missing = {f for f in wanted if given.get(f) is None}
        if missing or given.keys() - wanted:
            raise ValueError(f"{block} {kind.names[0]}: fields missing: {sorted(missing)}, unknown: {sorted(given.keys() - wanted)}")
        out[block] = (kind, dict(given))
    return out


def free_fields(options: Mapping[str, tuple[str, Mapping[str, object]]]) -> list[str]:
    """The fields, as block.field, that rows of parameters must bring."""
    return [f"{block}.{f}" for block, (_, given) in check(options).items() for f, v in given.items() if isinstance(v, str) and v.lower() == VARIABLE]


def deck(options: Mapping[str, tuple[str, Mapping[str, object]]], parameters: Mapping[str, Column] = {}) -> Column:
    """The deck's text, with a Column for each free field."""
    lines: list[Column] = []
    for block, (kind, given) in check(options).items():
        if kind.head:
            lines.append(F.lit(kind.head))
        for field, template in kind.fields:
            v = given[field]
            if isinstance(v, str) and v.lower() == VARIABLE:
                if f"{block}.{field}" not in parameters:
                    raise ValueError(f"{block}.{field} is variable and no parameter brings it")
                text = parameters[f"{block}.{field}"].cast("string")
            else:
                text = F.lit(", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v))
            before, after = template.split("{}")
            lines.append(F.concat(F.lit(before), text, F.lit(after)))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
