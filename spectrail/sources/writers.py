"""Files as bytes: VOTables, FITS images and tables, decks of dust properties."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Mapping, Sequence

import numpy as np

from spectrail.sources.tables import FITS_BLOCK, FITS_CARD

#: Fixed values of the FITS standard: the format letter of each kind of number.
FITS_LETTERS = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "u1": "B"}


def votable(fields: Sequence[Mapping[str, str]], rows: Iterable[Sequence[object]]) -> bytes:
    """One table; a field is its XML attributes, None an empty cell, a sequence an array cell."""
    root = ET.Element("VOTABLE", version="1.4", xmlns="http://www.ivoa.net/xml/VOTable/v1.3")
    table = ET.SubElement(ET.SubElement(root, "RESOURCE"), "TABLE")
    for f in fields:
        ET.SubElement(table, "FIELD", dict(f))
    data = ET.SubElement(ET.SubElement(table, "DATA"), "TABLEDATA")
    for row in rows:
        tr = ET.SubElement(data, "TR")
        for v in row:
            ET.SubElement(tr, "TD").text = v if isinstance(v, str) else "" if v is None else " ".join(map(repr, map(float, v))) if isinstance(v, (list, tuple, np.ndarray)) else repr(v)
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def _cards(values: Mapping[str, object]) -> bytes:
    out = b""
    for key, v in values.items():
        text = f"'{v}'" if isinstance(v, str) else ("T" if v else "F") if isinstance(v, bool) else str(v)
        out += f"{key:<8}= {text:>20}".ljust(FITS_CARD).encode("ascii")
    out += b"END".ljust(FITS_CARD)
    return out + b" " * (-len(out) % FITS_BLOCK)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % FITS_BLOCK)


def fits_image(image: np.ndarray, more: Mapping[str, object] = {}) -> bytes:
    """A primary image of doubles with further header values."""
    axes = {f"NAXIS{i + 1}": n for i, n in enumerate(reversed(image.shape))}
    return _cards({"SIMPLE": True, "BITPIX": -64, "NAXIS": image.ndim, **axes, **more}) + _padded(image.astype(">f8").tobytes())


def fits_table(columns: Mapping[str, np.ndarray]) -> bytes:
    """An empty primary unit and a binary table of number columns."""
    kinds = [(name, np.asarray(c).dtype.newbyteorder(">")) for name, c in columns.items()]
    rows = np.zeros(len(next(iter(columns.values()))), dtype=kinds)
    for name, c in columns.items():
        rows[name] = c
    named = {k: v for i, (name, kind) in enumerate(kinds) for k, v in ((f"TTYPE{i + 1}", name), (f"TFORM{i + 1}", FITS_LETTERS[kind.str[1:]]))}
    header = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(kinds), **named}
    return _cards({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}) + _cards(header) + _padded(rows.tobytes())


def dust_deck(name: str, grid: Mapping[str, object], species: Sequence[Mapping[str, object]]) -> str:
    """The deck of a dust mixture: general lines, then a block for each species with its sizes, in a table or a range."""
    lines = [name, int(grid["file_format"]), min(s["size_min"] for s in species), max(s["size_max"] for s in species), max(s["sizes"] for s in species)]
    lines += [grid["angles"], grid["angle_steps"], len(species), grid["gas_to_dust"], f"{grid['wavelength_min']} {grid['wavelength_max']} {grid['wavelengths']}", grid["processes"]]
    for s in species:
        table = s.get("size_table")
        lines += ["", s["abundance"], s["density"], s["constants"], "table" if table else "power", table or f"{s['size_min']} {s['size_max']} {s['power']}"]
    return "".join(f"{line}\n" for line in lines)
