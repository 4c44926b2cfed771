"""Readers on small files made here."""


import numpy as np
import pytest

from spectrail.sources import tables, writers

VOTABLE = """<?xml version="1.0"?><VOTABLE version="1.4" xmlns="http://www.ivoa.net/xml/VOTable/v1.3"><RESOURCE><TABLE>
<FIELD arraysize="15" datatype="unicodeChar" name="sed_filter"/><FIELD datatype="double" name="sed_flux" unit="mJy"/><FIELD datatype="double" name="sed_eflux" unit="mJy"/>
<DATA><TABLEDATA><TR><TD>2MASS:J</TD><TD>1.5</TD><TD>0.1</TD></TR><TR><TD>WISE:W1</TD><TD></TD><TD>0.2</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"""


def cards(**values):
    out = b""
    for k, v in values.items():
        text = f"'{v}'" if isinstance(v, str) else ("T" if v else "F") if isinstance(v, bool) else str(v)
        out += f"{k.replace('_', '-'):<8}= {text:>20}".ljust(80).encode()
    out += b"END".ljust(80)
    return out + b" " * (-len(out) % 2880)


def padded(data):
    return data + b"\0" * (-len(data) % 2880)


def test_votable(spark, tmp_path):
    (tmp_path / "a.vot").write_text(VOTABLE)
    rows = tables.read_votable_photometry(spark, str(tmp_path / "*.vot")).orderBy("filter").collect()
    assert [r["filter"] for r in rows] == ["2MASS:J", "WISE:W1"] and rows[0]["flux"] == 1.5 and rows[0]["unit"] == "mJy" and rows[1]["flux"] is None


def test_low_resolution_image(spark, tmp_path):
    names = ["wavelength", "flux", "error (RMS+SYS)", "module"]
    image = np.array([[7.0, 2.0, 0.1, 0.0, 9.0], [5.0, 1.0, 0.1, 1.0, 9.0], [30.0, 3.0, np.nan, 2.0, 9.0], [20.0, 4.0, 0.2, 3.0, 9.0]], dtype=">f8")
    header = cards(SIMPLE=True, BITPIX=-64, NAXIS=2, NAXIS1=5, NAXIS2=4, **{f"COL{i + 1:02d}DEF": n for i, n in enumerate(names)})
    (tmp_path / "a.fits").write_bytes(header + padded(image.tobytes()))
    rows = tables.read_spectrum(spark, str(tmp_path / "a.fits"), "SPITZER-YAAAR").collect()
    assert [(r["wavelength"], r["chunk"]) for r in rows] == [(5.0, 1), (7.0, 1), (20.0, 2)]


def test_binary_table(spark, tmp_path):
    primary = cards(SIMPLE=True, BITPIX=8, NAXIS=0)
    rows = np.array([(1.0, 2.0, 0.5), (2.0, 4.0, 0.5)], dtype=[("w", ">f8"), ("f", ">f4"), ("e", ">f4")])
    header = cards(XTENSION="BINTABLE", BITPIX=8, NAXIS=2, NAXIS1=16, NAXIS2=2, PCOUNT=0, GCOUNT=1, TFIELDS=3, TTYPE1="w", TFORM1="D", TTYPE2="f", TFORM2="1E", TTYPE3="e", TFORM3="E")
    (tmp_path / "t.fits").write_bytes(primary + header + padded(rows.tobytes()))
    got = tables.read_spectrum(spark, str(tmp_path / "t.fits"), "User-Defined", "fits", wavelength="w", flux="f", uncertainty="e", flux_unit="mJy").orderBy("wavelength").collect()
    assert [r["value"] for r in got] == pytest.approx([0.002, 0.004])


def test_lrs_blocks(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Name\n8.0 1e-12\n9.0 2e-12\n-------------------\n12.0 3e-12\n")
    rows = tables.read_spectrum(spark, str(tmp_path / "l.txt"), "IRAS-LRS").orderBy("wavelength").collect()
    assert [r["module"] for r in rows] == [1, 1, 2] and rows[0]["value"] == pytest.approx(1e-12 * 8e-6 / 2.99792458e8 * 1e26)


def test_user_text_and_log(spark, tmp_path):
    (tmp_path / "u.csv").write_text("w,f,e\n10,1,0.1\n20,2,0.2\n")
    rows = tables.read_spectrum(spark, str(tmp_path / "u.csv"), "User-Defined", "text", wavelength="w", flux="f", uncertainty="e", wavelength_unit="um", flux_unit="Jy").collect()
    assert len(rows) == 2 and rows[0]["chunk"] == 1
    with pytest.raises(ValueError):
        tables.read_user_text(spark, str(tmp_path / "u.csv"), "w", "f", None, "um", "Jy")
    with pytest.raises(ValueError):
        tables.read_spectrum(spark, "x", "nothing")
    (tmp_path / "a.log").write_text("2022-12-19 10:33:51,945 [MainThread  ] [INFO ]  ready\nno line\n")
    log = tables.read_log(spark, str(tmp_path / "a.log")).collect()
    assert len(log) == 1 and log[0]["level"] == "INFO" and log[0]["message"] == "ready"


def test_filters(spark, tmp_path):
    (tmp_path / "K.csv").write_text("wavelength,transmission\nnm,Photon\n2000,0.0\n2200,1.0\n2400,0.0\n")
    rows = tables.read_filter_csv(spark, str(tmp_path / "K.csv")).orderBy("wavelength").collect()
    assert [r["wavelength"] for r in rows] == pytest.approx([2.0, 2.2, 2.4]) and rows[0]["detector"] == "photon" and rows[0]["filter"] == "K"
    library = spark.createDataFrame([("K", "photon", 2.0, 0.5), ("K", "photon", 2.0, 0.5), ("J", "energy", 1.2, 1.0)], "filter string, detector string, wavelength double, transmission double")
    tables.write_filter_library(library, str(tmp_path / "lib"))
    assert spark.read.parquet(str(tmp_path / "lib")).count() == 2
    tables.write_filter_csv(library.where("filter = 'J'"), str(tmp_path / "out"), "energy", "um")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()][:2] == ["wavelength,transmission", "um,energy"]


def test_opacities(spark, tmp_path):
    (tmp_path / "b_sub.q").write_text("#lam qext_sub qext\n1.0 0.5 1.5\n2.0 0.6 1.6\n")
    (tmp_path / "a_sub.q").write_text("1.0 0.1\n")
    rows = tables.read_opacities(spark, str(tmp_path / "*sub.q")).orderBy("species", "wavelength").collect()
    assert [(r["species"], r["species_idx"], r["q"]) for r in rows] == [("a", 0, 0.1), ("b", 1, 0.5), ("b", 1, 0.6)]
    (tmp_path / "list.txt").write_text("b_sub.q  \na_sub.q\n")
    listed = tables.read_opacity_list(spark, str(tmp_path / "list.txt"), str(tmp_path)).collect()
    assert {(r["species"], r["species_idx"]) for r in listed} == {("b_sub.q", 0), ("a_sub.q", 1)}


def test_runs(spark, tmp_path):
    chains = spark.createDataFrame([(0, 0, [1.0], -1.0)], "walker int, step int, theta array<double>, lnprob double")
    tables.write_run(chains, str(tmp_path / "run"), {"walkers": 1})
    back, meta = tables.read_run(spark, str(tmp_path / "run"))
    assert back.count() == 1 and meta == {"walkers": 1}


def test_own_log_reads_back(spark, tmp_path):
    import logging
    import sys

    from spectrail.plans import logs

    hook = sys.excepthook
    try:
        log = logs.set_up(folder=str(tmp_path), name="run", terminal=False)
        logs.set_up(folder=str(tmp_path), name="run", terminal=False)
        log.info("ready")
        log.debug("hidden")
        logs.report(ValueError, ValueError("lost"), None)
    finally:
        sys.excepthook = hook
        logging.getLogger(logs.NAME).handlers.clear()
    rows = tables.read_log(spark, str(tmp_path / "run.log")).orderBy("ts").collect()
    assert [(r["level"], r["message"]) for r in rows] == [("INFO", "ready"), ("CRITICAL", "uncaught error")] and rows[0]["ts"] is not None


def test_dust_deck():
    species = [{"abundance": 0.7, "density": 3.3, "constants": "a.lnk", "size_min": 0.01, "size_max": 1.0, "sizes": 101, "power": -3.5}, {"abundance": 0.3, "density": 2.0, "constants": "b.lnk", "size_min": 0.005, "size_max": 0.25, "sizes": 51, "power": -3.5, "size_table": "b.size"}]
    grid = {"file_format": 2, "angles": 31, "angle_steps": 5, "gas_to_dust": 200, "wavelength_min": 0.1, "wavelength_max": 1000.0, "wavelengths": 333, "processes": 1}
    lines = writers.dust_deck("mix", grid, species).split("\n")
    assert lines[:5] == ["mix", "2", "0.005", "1.0", "101"] and lines[11:17] == ["", "0.7", "3.3", "a.lnk", "power", "0.01 1.0 -3.5"] and lines[17:23] == ["", "0.3", "2.0", "b.lnk", "table", "b.size"]


def test_deck_options(spark):
    from spectrail.operators import decks
    from spectrail.plans import files

    assert decks.free_fields(files.DECK) == ["spectrum.temperatures", "scale.temperature"]
    for block, (_, fields) in files.DECK.items():
        with pytest.raises(ValueError):
            decks.check({**files.DECK, block: ("nothing", fields)})
        with pytest.raises(ValueError):
            decks.check({**files.DECK, block: (files.DECK[block][0], {})})
    with pytest.raises(ValueError):
        decks.deck(files.DECK)
    with pytest.raises(ValueError):
        decks.illumination("sphere", True, True)
    with pytest.raises(ValueError):
        decks.illumination("slab", angle=86.0)
    assert decks.illumination("slab") == "angular distribution = ISOTROPIC" and decks.illumination("sphere", external=True) == decks.EXTERNAL
    for block, kinds in decks.BLOCKS.items():
        names = [n for k in kinds for n in k.names]
        assert len(set(names)) == len(names) and all(decks.choose(block, n.upper()).names for n in names)
