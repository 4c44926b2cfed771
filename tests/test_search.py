"""Whole fits, and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.operators import diagnostics, models, samplers
from spectrail.plans import search
from spectrail.streaming import ingest


@pytest.fixture(scope="module")
def fit():
    """A line seen through two bands and a spectrum."""
    rng = np.random.default_rng(12)
    grid = np.linspace(1, 20, 191)
    truth = 0.5 * grid + 3
    filters = [(np.array([3.0, 3.1, 5.0, 5.1]), np.array([0.0, 1.0, 1.0, 0.0]), "photon"), (np.array([12.0, 14.0, 16.0]), np.array([0.0, 1.0, 0.0]), "energy")]
    bands = search.band_matrix(grid, filters)
    phot = search.Photometry("phot", bands, truth @ bands.T, np.array([0.05, 0.05]))
    x = np.linspace(6, 11, 25)
    spec = search.SpectrumData("spec", x, 0.5 * x + 3 + 0.1 * rng.standard_normal(25), np.full(25, 0.1), mask=np.arange(25) != 7, resample="exact")
    return search.Search(models.StraightLine(), grid, (search.uniform(-5, 5), search.uniform(-20, 20)), (phot, spec))


def test_parts(fit):
    assert fit.layout.labels == ("slope", "intercept", "calibration", "weight", "length")
    theta = np.array([[0.5, 3.0, 1.0, 0.1, 0.1], [9.0, 3.0, 1.0, 0.1, 0.1], [0.5, 3.0, 1.0, -0.1, 0.1]])
    lp = fit.lnprob(theta)
    assert np.isfinite(lp[0]) and lp[1] == lp[2] == -np.inf
    u = fit.transform(np.full((1, 5), 0.5))
    assert np.allclose(u[0, :3], [0, 0, 1]) and u[0, 3] == pytest.approx(0.2 * 0.6744898, rel=1e-5)
    assert fit.simulate(np.repeat(theta[:1], 3, axis=0), np.random.default_rng(1)).shape == (3, 26) and len(fit.observed()) == 26


def test_ensemble(spark, fit):
    sampler = samplers.EnsembleMCMC(24, 500, 250, (("de", 0.7), ("stretch", 0.3)))
    chains = fit.sample(spark, sampler, chains=2, guess=np.array([0.4, 2.5, 1.0, 0.1, 0.1]), seed=3).cache()
    rows = {(r["statistic"], r["parameter"]): r["value"] for r in fit.summary(chains.where("chain = 0"), 24, 250).collect()}
    assert rows["median", "slope"] == pytest.approx(0.5, abs=0.03) and rows["median", "intercept"] == pytest.approx(3.0, abs=0.25)
    draws = diagnostics.draw_rows(chains.select("run_id", "chain", "walker", "step", "theta"), ["run_id"], ["chain", "step", "walker"], 40, 5).withColumnRenamed("draw", "sample_id")
    band = diagnostics.predictive_band(fit.predictive(draws), ["grid_idx"], "flux")
    assert band.count() == len(fit.grid) and band.where("low > high").count() == 0


def test_nested_and_simulations(spark, fit):
    out = fit.nested(spark, samplers.NestedSampler(60, 1.0), replicates=2, seed=4)
    z = [r["logz"] for r in out.groupBy("run_id").agg(F.max_by("logz", "iter").alias("logz")).collect()]
    assert len(z) == 2 and abs(z[0] - z[1]) < 6
    draws = fit.infer_from_simulations(spark, samplers.SequentialPosterior(3000, 2, 500), seed=6)
    mean = draws.select(F.avg(F.col("theta")[0])).first()[0]
    assert draws.count() == 500 and mean == pytest.approx(0.5, abs=0.2)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"object_id": 1, "filter": "WISE:W1", "wavelength": 3400.0, "wavelength_unit": "nm", "value": 2.0, "uncertainty": 0.1, "flux_unit": "mJy"}, {"object_id": 2, "filter": "x", "wavelength": 90.0, "wavelength_unit": "um", "value": None, "uncertainty": 0.1, "flux_unit": "Jy"}, {"object_id": 3, "filter": "x", "wavelength": 90.0, "wavelength_unit": "um", "value": 1.0, "uncertainty": 0.1, "flux_unit": "Jy"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ingest.stream_photometry(spark, str(tmp_path / "in"), 1.0, 10.0)
    ingest.write_observations(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r["object_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1]["value"] == pytest.approx(2e-3) and got[1]["filter"] == "WISE_RSR_W1" and got[1]["mask"] and not got[3]["mask"] and 2 not in got


def test_simulations_are_kept_and_learned_from(spark, fit, tmp_path):
    """Cached simulations, an embedding of one's own, and a posterior that isn't a Gaussian."""
    made = fit.simulations(spark, n=2000, seed=6)
    made.write.parquet(str(tmp_path / "simulations"))
    kept = spark.read.parquet(str(tmp_path / "simulations"))
    again = {r["sample_id"]: r["x"] for r in fit.simulations(spark, n=2000, seed=6).repartition(3).collect()}
    assert all(again[r["sample_id"]] == r["x"] for r in kept.collect())
    embed = lambda x: x[:, :10] + x[:, 10:20]
    for sampler in (samplers.SequentialPosterior(2000, 1, 300), samplers.SequentialPosterior(2000, 2, 300, embed=embed), samplers.SequentialPosterior(2000, 2, 300, nearest=0.3)):
        draws = fit.infer_from_simulations(spark, sampler, seed=6, cached=kept)
        rows = np.array([r["theta"] for r in draws.collect()])
        assert len(rows) == 300 and (fit.lnprior(rows) > -np.inf).all()
        assert rows[:, 0].mean() == pytest.approx(0.5, abs=0.3) and rows[:, 1].mean() == pytest.approx(3.0, abs=3.0)


def test_one_call(spark, fit, tmp_path):
    out = fit(spark, samplers.EnsembleMCMC(16, 120, 60), guess=np.array([0.5, 3.0, 1.0, 0.1, 0.1]), path=str(tmp_path / "report"), seed=8)
    assert {"chains", "summary", "trace", "lnprob", "predictive"} == out.keys() and out["predictive"].count() == len(fit.grid) and out["lnprob"].count() == 60
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[-1].startswith("run: acceptance = ") and sorted(x.split(":")[0] for x in lines[:-1]) == sorted(fit.layout.labels)
    other = fit.with_parts(model_priors=(search.uniform(-1, 1), search.uniform(0, 9)))
    narrow = fit.with_parts(own_lnprior=lambda t: np.where(t[:, 0] > 0, 0.0, -np.inf))
    assert narrow.lnprior(np.array([[-0.5, 3.0, 1.0, 0.1, 0.1]]))[0] == -np.inf and fit.lnprior(np.array([[-0.5, 3.0, 1.0, 0.1, 0.1]]))[0] > -np.inf
    assert other.priors[0].lnpdf(np.array([2.0]))[0] == -np.inf and other.datasets is fit.datasets


def test_autocorrelation_time_by_walkers(spark):
    rng = np.random.default_rng(2)
    rows = []
    for w in range(6):
        x = 0.0
        for s in range(300):
            x = 0.8 * x + rng.standard_normal()
            rows.append(("a", w, s, float(x)))
    df = spark.createDataFrame(rows + [("b", 0, s, 1.0) for s in range(9)], "p string, walker int, step int, value double").repartition(5)
    got = {r["p"]: r["tau"] for r in diagnostics.autocorrelation_time(df, ["p"], "value", "walker", "step").collect()}
    x = np.array([v for *_, v in rows]).reshape(6, 300)
    x = x - x.mean(axis=1, keepdims=True)
    rho = np.mean([[(r[: 300 - k] * r[k:]).sum() / (r * r).sum() for k in range(300)] for r in x], axis=0)
    assert got["a"] == pytest.approx(diagnostics.integrated_time(rho), rel=1e-9) and 3 < got["a"] < 14
    assert got["b"] is None or np.isnan(got["b"])
