"""Operators against NumPy, analytic results and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectrail.functions import physics, stats, units
from spectrail.operators import align, diagnostics, integrate, models, noise, priors, samplers, select
from spectrail.plans import layout


def column(spark, expr, **values):
    row = spark.range(1)
    for name, v in values.items():
        row = row.withColumn(name, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return row.select(expr.alias("r")).first()[0]


def long(spark, x, y):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "id int, x double, y double")


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 40))
    y = rng.normal(size=40)
    t = np.concatenate([rng.uniform(-2, 12, 60), x[:5]])
    targets = spark.createDataFrame([(1, float(v), i) for i, v in enumerate(t)], "id int, x double, tag int")
    got = {r["tag"]: r["y"] for r in align.interpolate(long(spark, x, y), targets, ["id"], "x", "y").collect()}
    assert np.allclose([got[i] for i in range(len(t))], np.interp(t, x, y), atol=1e-12)


def test_interpolation_outside(spark):
    samples = long(spark, [1, 2, 4], [10, 100, 1000])
    targets = spark.createDataFrame([(1, 0.0), (1, 6.0), (1, 3.0)], "id int, x double")
    null = {r["x"]: r["y"] for r in align.interpolate(samples, targets, ["id"], "x", "y", "null").collect()}
    assert null[0.0] is None and null[6.0] is None and null[3.0] == pytest.approx(550)
    more = {r["x"]: r["y"] for r in align.interpolate(samples, targets, ["id"], "x", "y", "extrapolate", log_y=True).collect()}
    assert more[0.0] == pytest.approx(1.0) and more[6.0] == pytest.approx(1e4)
    with pytest.raises(Exception, match="no sample beside"):
        align.interpolate(samples, targets, ["id"], "x", "y", "error").collect()
    with pytest.raises(ValueError):
        align.interpolate(samples, targets, ["id"], "x", "y", "wrap")


def test_rebin_matches_numpy_and_conserves(spark):
    rng = np.random.default_rng(4)
    x, y = np.arange(30.0), rng.uniform(1, 2, 30)
    b = 3 + 2.7 * np.arange(8)
    got = {r["x"]: r["y"] for r in align.rebin(long(spark, x, y), spark.createDataFrame([(1, float(v)) for v in b], "id int, x double"), ["id"], "x", "y", 3.0).collect()}
    want = align.rebin_np(b, x, y)
    assert np.allclose([got[v] for v in b], want, rtol=1e-12)
    assert (want * 2.7).sum() == pytest.approx(np.interp(3 + 2.7 * 7.5, np.arange(31) - 0.5, np.r_[0, y.cumsum()]) - np.interp(3 - 1.35, np.arange(31) - 0.5, np.r_[0, y.cumsum()]))
    assert np.isnan(align.rebin_np(np.array([100.0, 101.0]), x, y)).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=30), st.floats(0.3, 4))
def test_rebin_of_a_constant_is_constant(values, width):
    x = np.arange(len(values), dtype=float)
    bins = np.arange(0.5, len(values) - 0.5, width)
    if len(bins) > 1:
        out = align.rebin_np(bins, x, np.full(len(x), 3.0))
        assert np.allclose(out[~np.isnan(out)], 3.0)


@pytest.mark.parametrize("detector", integrate.DETECTORS)
def test_constant_photon_flux_gives_constant_band_flux(spark, detector):
    grid = [float(v) for v in range(1, 20)]
    flux = spark.createDataFrame([(1, w, 5.0 * w * w) for w in grid], "id int, wavelength double, flux double")
    filters = spark.createDataFrame([("f", detector, w, 1.0 if 5 <= w <= 9 else 0.0) for w in grid], "filter string, detector string, wavelength double, transmission double")
    row = integrate.band_fluxes(flux, filters, ["id"]).first()
    assert row["flux"] == pytest.approx(5.0 * row["lpivot"] ** 2)
    assert integrate.pivot_wavelength(filters).first()["lpivot"] == pytest.approx(row["lpivot"])


def test_intervals_partition(spark):
    rows = spark.range(20)
    low = rows.where(select.in_interval(F.col("id"), 0, 7, "right-open")).count()
    high = rows.where(select.in_interval(F.col("id"), 7, 19, "closed")).count()
    assert low + high == 20
    with pytest.raises(ValueError):
        select.in_interval(F.col("id"), 0, 1, "ajar")


def test_clean_and_names(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, math.inf), (4, None)], "a int, b double")
    assert [r["a"] for r in select.finite_rows(df).collect()] == [1]
    assert column(spark, select.filter_name(F.lit("WISE:W1/x"))) == "WISE_RSR_W1_x"
    assert column(spark, select.filter_name(F.lit("WISE_RSR_W1"))) == "WISE_RSR_W1"
    assert column(spark, select.filter_name(F.lit("Spitzer_MIPS"))) == "SPITZER_MIPS"


def test_units(spark):
    assert column(spark, units.to_um(F.lit(100.0), F.lit("GHz"))) == pytest.approx(2997.92458)
    assert column(spark, units.to_um(F.lit(5000.0), F.lit("Angstrom"))) == pytest.approx(0.5)
    assert column(spark, units.to_jy(F.lit(2.0), F.lit("mJy"), F.lit(1.0))) == pytest.approx(2e-3)
    assert column(spark, units.to_jy(F.lit(1.0), F.lit("erg/s/cm2/angstrom"), F.lit(1.0))) == pytest.approx(1e23 * 1e8 / 2.99792458e18)
    with pytest.raises(Exception, match="unknown wavelength unit"):
        column(spark, units.to_um(F.lit(1.0), F.lit("furlong")))
    flux, error = units.magnitude_to_jy(F.lit(2.5), F.lit(0.1), F.lit(100.0))
    assert column(spark, flux) == pytest.approx(10.0)
    assert column(spark, error) == pytest.approx(units.magnitude_error(10.0, 0.1))


def test_gap_split(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 9.0, 10.0, 20.0])] + [(2, 0, 1.0)], "k int, i int, x double")
    out = {(r["k"], r["i"]): r["chunk"] for r in select.gap_split(df, ["k"], "x", ["i"], 5.0).collect()}
    assert [out[1, i] for i in range(5)] == [1, 1, 2, 2, 2] and out[2, 0] == 1


@pytest.mark.parametrize("model,theta", [
    (models.StraightLine(), [0.3, -1.0]),
    (models.ModifiedBlackbody(), [40.0, -2.0, 1.7, 300.0]),
    (models.ScaledBlackbody(redshift=0.3), [60.0, 1.0, 1.2, 1.0]),
    (models.Composite(models.StraightLine(), models.StraightLine(), "*"), [1.0, 2.0, 3.0, 4.0]),
])
def test_model_twins(spark, model, theta):
    grid = spark.createDataFrame([(i, float(w)) for i, w in enumerate([1.0, 10.0, 70.0, 850.0])], "grid_idx int, wavelength double")
    params = spark.createDataFrame([(1, theta)], "sample_id int, theta array<double>")
    got = [r["flux"] for r in models.evaluate(params, grid, model).orderBy("grid_idx").collect()]
    assert np.allclose(got, model.flux_np(np.array([1.0, 10.0, 70.0, 850.0]), np.array([theta]))[0], rtol=1e-11, atol=1e-300)


def test_shell_twin(spark):
    shell = models.DustShell()
    got = column(spark, shell.flux(F.lit(30.0), F.lit(120.0), F.lit(60.0), F.lit(0.4)))
    assert got == pytest.approx(float(shell.flux_np(np.array([30.0]), 120.0, 60.0, np.array([0.4]))[0]))


def test_planck_and_distance(spark):
    assert column(spark, physics.planck_jy(F.lit(0.001), F.lit(3.0))) == 0.0
    assert column(spark, physics.luminosity_distance_mpc(F.lit(0.5))) == pytest.approx(float(physics.luminosity_distance_mpc_np(np.array([0.5]))[0]))
    assert float(physics.luminosity_distance_mpc_np(np.array([0.5]))[0]) == pytest.approx(2832.9, abs=2)


def test_extinction_laws(spark):
    a, b = models.ccm_coefficients(F.lit(1.82))
    assert column(spark, a) == pytest.approx(1.0) and column(spark, b) == pytest.approx(0.0)
    curve = models.f99_curve(np.array([2.65, 0.547, 0.2175]))
    assert curve[0] == pytest.approx(0.0854, abs=1e-3) and curve[1] == pytest.approx(3.055 / 3.1, abs=2e-3) and curve[2] > 2.5
    law = models.F99Extinction(r_v=3.1)
    assert law.labels == ("a_v",)
    assert np.allclose(law.factor_np(np.array([0.547]), np.array([[1.0]])), 10 ** (-0.4 * curve[1]))


def test_dust_masses(spark):
    """Published central values of a fit."""
    from spectrail.plans.modelling import dust_mass

    got = {(r["species"], r["component"]): 10 ** r["log_mass"] for r in dust_mass(spark, "").collect()}
    want = {
        ("amorphous olivine", "cold"): 4.75e-2, ("iron", "warm"): 1.51e-5, ("forsterite", "cold"): 5.7e-4, ("clino-enstatite", "cold"): 3.9e-6,
        ("water ice", "cold"): 1.5e-5, ("diopside", "cold"): 3.0e-5, ("calcite", "cold"): 1.5e-5, ("dolomite", "cold"): 5.5e-6,
        ("amorphous olivine", "warm"): 6.8e-6, ("forsterite", "warm"): 8.7e-8, ("clino-enstatite", "warm"): 8.8e-8,
    }
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=0.03)


@settings(max_examples=30, deadline=None)
@given(st.floats(1e-6, 1 - 1e-6))
def test_probit_constants(u):
    from statistics import NormalDist

    # The same approximation in Python.
    a, b, c, d = stats.ACKLAM_A, stats.ACKLAM_B, stats.ACKLAM_C, stats.ACKLAM_D
    if u < stats.ACKLAM_EDGE or u > 1 - stats.ACKLAM_EDGE:
        t = math.sqrt(-2 * math.log(min(u, 1 - u)))
        v = np.polyval(c, t) / np.polyval(d, t) * (1 if u < 0.5 else -1)
    else:
        q = u - 0.5
        v = np.polyval(a, q * q) * q / np.polyval(b, q * q)
    assert v == pytest.approx(NormalDist().inv_cdf(u), abs=1e-7)


def test_priors(spark):
    for u in (0.01, 0.3, 0.9, 0.999):
        from statistics import NormalDist

        assert column(spark, stats.probit(F.lit(u))) == pytest.approx(NormalDist().inv_cdf(u), abs=1e-7)
    assert column(spark, priors.box([F.lit(1.0)], [(1.0, 2.0)])) == -math.inf
    assert column(spark, priors.box([F.lit(1.0)], [(1.0, 2.0)], closed=True)) == 0.0
    assert column(spark, priors.joint(F.lit(math.nan), F.lit(1.0))) == -math.inf
    w = column(spark, priors.dirichlet_transform(F.array(*map(F.lit, (0.2, 0.5, 0.9)))))
    assert sum(w) == pytest.approx(1.0)
    assert column(spark, priors.dirichlet_lnpdf(F.array(F.lit(0.2), F.lit(0.3)), 3)) == pytest.approx(math.log(2))
    assert priors.resolve(None, priors.normal(0, 1)).lnpdf is not None
    draws = priors.sample(spark.range(500), "id", [priors.uniform(2.0, 4.0), priors.normal(0.0, 1.0)], 3)
    one, two = draws.coalesce(1).orderBy("id").collect(), draws.repartition(7).orderBy("id").collect()
    assert one == two
    assert 2.0 <= min(r["theta"][0] for r in one) and max(r["theta"][0] for r in one) <= 4.0


def test_importance_normalisation(spark):
    draws = priors.sample(spark.range(2000), "id", [priors.normal(0.0, 1.0)], 5).withColumn("x", F.col("theta")[0])
    p = priors.normal(0.0, 0.5).lnpdf(F.col("x"))
    out = priors.importance_normalisation(draws.withColumn("p", p).withColumn("q", priors.normal(0.0, 1.0).lnpdf(F.col("x"))), "p", "q").first()
    assert out["mass"] == pytest.approx(1.0, abs=0.05)


def test_dense_likelihood_matches_definition(spark):
    rng = np.random.default_rng(5)
    x, sd = np.linspace(1, 5, 12), rng.uniform(0.1, 0.3, 12)
    value = rng.normal(size=12)
    spectrum = noise.Spectrum(x, value, sd)
    theta = np.array([[1.02, 0.3, 0.8], [0.97, 0.0, 1.0], [1.0, 0.3, 0.8]])
    flux = rng.normal(size=(3, 12))
    got = spectrum.lnlike(theta, flux)
    for i in range(3):
        c = noise.covariance(x, sd, theta[i, 1], theta[i, 2])
        r = theta[i, 0] * value - flux[i]
        want = -0.5 * r @ np.linalg.inv(c) @ r - 0.5 * np.linalg.slogdet(c)[1] - 6 * math.log(2 * math.pi)
        assert got[i] == pytest.approx(want, rel=1e-9)
    df = spark.createDataFrame([(i, flux[i].tolist(), theta[i].tolist()) for i in range(3)], "id int, flux array<double>, noise array<double>")
    rows = {r["id"]: r["lnlike"] for r in noise.lnlike_correlated(df.repartition(3), spectrum).collect()}
    assert np.allclose([rows[i] for i in range(3)], got)
    flux[0, 0] = math.nan
    assert spectrum.lnlike(theta, flux)[0] == -math.inf


def test_indefinite_covariance():
    c = np.diag([1.0, -1.0])
    assert noise.lnlike_correlated_np(np.ones(2), c) == -math.inf
    assert noise.lnlike_correlated_np(np.ones(2), -np.eye(2), strict=True) == -math.inf
    assert math.isfinite(noise.lnlike_correlated_np(np.ones(2), -np.eye(2)))


def test_pair_closed_form(spark):
    c = noise.covariance(np.array([0.0, 0.7]), np.array([0.2, 0.3]), 0.4, 0.5)
    want = noise.lnlike_correlated_np(np.array([0.1, -0.2]), c)
    got = column(spark, noise.lnlike_pair(F.lit(0.1), F.lit(-0.2), F.lit(0.2), F.lit(0.3), F.lit(0.7), F.lit(0.4), F.lit(0.5)))
    assert got == pytest.approx(want)


def test_simulations_do_not_depend_on_partitions(spark):
    spectrum = noise.Spectrum(np.linspace(0, 1, 5), np.ones(5), np.full(5, 0.1))
    params = spark.createDataFrame([(i, [1.0, 0.2, 0.3]) for i in range(40)], "sample_id long, theta array<double>")
    sim = lambda t, s: spectrum.simulate(t, np.ones((len(t), 5)), s)
    one = noise.simulate_batches(params.coalesce(1), sim).orderBy("sample_id").collect()
    two = noise.simulate_batches(params.repartition(8), sim).orderBy("sample_id").collect()
    assert one == two
    x = np.array([r["x"] for r in one])
    assert abs(x.mean() - 1) < 0.1 and 0.05 < x.std() < 0.2


LINE = np.linspace(0, 1, 20)


def line_problem():
    rng = np.random.default_rng(0)
    y = 2 * LINE + 1 + 0.1 * rng.standard_normal(20)
    design = np.column_stack([LINE, np.ones(20)])
    cov = np.linalg.inv(design.T @ design) * 0.01
    mean = cov @ design.T @ y / 0.01
    like = lambda t: -0.5 * (((t[:, :1] * LINE + t[:, 1:2] - y) / 0.1) ** 2).sum(1) - 20 * math.log(0.1 * math.sqrt(2 * math.pi))
    return y, mean, cov, like


@pytest.mark.parametrize("sampler", [
    samplers.EnsembleMCMC(32, 1200, 400),
    samplers.EnsembleMCMC(32, 1200, 400, (("de", 0.8), ("snooker", 0.2))),
    samplers.EnsembleSlice(32, 400, 150),
])
def test_chains_find_the_analytic_posterior(sampler):
    _, mean, cov, like = line_problem()
    f = lambda t: np.where((np.abs(t) < 10).all(axis=1), like(t), -np.inf)
    rng = np.random.default_rng(1)
    chain, _, _ = sampler.run(f, samplers.start_walkers(f, rng, 32, np.array([1.0, 1.0]), None), rng)
    flat = chain.reshape(-1, 2)
    tau = max(diagnostics.integrated_time(np.mean([diagnostics.walker_autocorrelation(w) for w in chain[:, :, i].T], axis=0)) for i in range(2))
    error = np.sqrt(np.diag(cov) * tau / len(flat))
    assert (np.abs(flat.mean(axis=0) - mean) < 5 * error + 1e-4).all()
    assert np.allclose(flat.std(axis=0), np.sqrt(np.diag(cov)), rtol=0.1)


def test_nested_sampling_finds_the_evidence():
    _, mean, cov, like = line_problem()
    out = samplers.NestedSampler(200, 0.05).run(like, lambda u: -10 + 20 * u, 2, np.random.default_rng(2))
    truth = like(mean[None])[0] + math.log(2 * math.pi) + 0.5 * math.log(np.linalg.det(cov)) - math.log(400)
    info = 6.0  # nats, about
    assert abs(out["logz"].iloc[-1] - truth) < 4 * math.sqrt(info / 200)
    assert (np.diff(out["logl"]) >= -1e-9).all()


def test_likelihood_free_posterior():
    y, mean, cov, _ = line_problem()
    rng = np.random.default_rng(3)
    draws = samplers.SequentialPosterior(2000, 2, 4000).run(
        lambda n, r: r.uniform(-10, 10, (n, 2)), lambda t: (np.abs(t) < 10).all(axis=1), lambda t, r: t[:, :1] * LINE + t[:, 1:2] + 0.1 * r.standard_normal((len(t), 20)), y, rng)
    assert np.allclose(draws.mean(axis=0), mean, atol=0.02)
    assert np.allclose(draws.std(axis=0), np.sqrt(np.diag(cov)), rtol=0.15)


def test_chains_run_per_group(spark):
    _, mean, _, like = line_problem()
    df = spark.createDataFrame([(1,), (2,)], "object_id int")
    problem = lambda pdf: samplers.Problem(like, 2, np.array([1.0, 1.0]))
    sampler = samplers.EnsembleMCMC(16, 60, 20)
    out = samplers.run_chains(df, ["object_id"], problem, sampler, chains=2, seed=4)
    assert out.count() == 2 * 2 * 16 * 40
    again = samplers.run_chains(df.repartition(5), ["object_id"], problem, sampler, chains=2, seed=4)
    assert out.orderBy("object_id", "chain", "step", "walker").collect() == again.orderBy("object_id", "chain", "step", "walker").collect()
    table = {(r["statistic"], r["parameter"]): r["value"] for r in diagnostics.summary(out.where("object_id = 1 AND chain = 0"), ["a", "b"], 16, 40).collect()}
    assert table["median", "a"] == pytest.approx(mean[0], abs=0.2) and ("rhat", "b") in table and ("map", "a") in table and ("ess", None) in table


def test_effective_samples_of_a_known_run():
    assert diagnostics.effective_samples(50, 50_000, 4460.09107) == pytest.approx(560.527, abs=1e-3)


def test_layout():
    found = layout.ParamLayout.of((2, None), [("phot", 0, None), ("spec", 3, ["calVar", "weight", "length"])])
    assert found.size == 5 and found.labels == ("x0", "x1", "calVar", "weight", "length") and found["spec"].offset == 2
    with pytest.raises(ValueError):
        layout.ParamLayout.of((2, ["a"]), [])
    assert layout.parameter_count(models.StraightLine()) == 2
    assert layout.parameter_count(lambda a, b, c: 0) == 3
    assert layout.run_name("m", ["d"], "s", "short", "t") == "t_s"


def test_resamplers(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0], [1.0, 3.0, 5.0], [0.5, 1.5])], "x array<double>, y array<double>, n array<double>")
    assert align.resample_arrays(df, "x", "y", "n", "o").first()["o"] == [2.0, 4.0]
    assert align.resample_arrays(df, "x", "y", "n", "o", lambda n, x, y: np.full(len(n), 7.0)).first()["o"] == [7.0, 7.0]


def test_quantiles_by_counting_match_numpy(spark):
    rng = np.random.default_rng(8)
    groups = {1: rng.normal(size=501), 2: np.repeat([1.0, 2.0], 50), 3: np.array([4.0]), 4: np.exp(rng.normal(size=300) * 5)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None), (1, math.nan)], "k int, v double")
    got = {(r["k"], r["probability"]): r["quantile"] for r in diagnostics.exact_quantiles(df, ["k"], "v", [0.0, 0.16, 0.5, 0.84, 1.0], bins=16).collect()}
    for k, vs in groups.items():
        for p in (0.0, 0.16, 0.5, 0.84, 1.0):
            assert got[k, p] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12)


@pytest.mark.parametrize("n,chunks", [(10, 2), (11, 2), (11, 3), (2, 3), (100, 7)])
def test_flat_ranks_and_chunks_match_array_split(spark, n, chunks):
    rng = np.random.default_rng(n)
    df = spark.createDataFrame([(1, int(rng.integers(3)), i, float(i)) for i in range(n)], "p int, walker int, step int, v double")
    ranked = diagnostics.flat_ranks(df, ["p"], ["walker", "step"]).withColumn("c", diagnostics._chunk(F.col("_r"), F.col("_n"), chunks))
    rows = sorted(ranked.collect(), key=lambda r: (r["walker"], r["step"]))
    assert [r["_r"] for r in rows] == list(range(1, n + 1))
    assert [r["c"] for r in rows] == [i + 1 for i, part in enumerate(np.array_split(np.arange(n), chunks)) for _ in part]


def test_correlated_likelihood_takes_each_class_s_first_spectrum(spark, tmp_path):
    from spectrail.plans import posteriors

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist(), label) for i, label in enumerate([1, 0, 1, 2, 0, None, 2, None])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    first = {}
    for _, flux, label in rows:
        first.setdefault(label, np.array(flux, dtype=np.float32).astype(float))
    out = posteriors.lnlike_corr_dense(spark, str(tmp_path)).collect()
    assert len(out) == 3 * len(rows)
    for r in out:
        _, flux, label = rows[r["vec_id"]]
        scale, weight, length = r["noise"]
        cov = noise.covariance(np.arange(6.0), np.full(6, 0.5), weight, length, noise.TRUNCATION)
        residual = scale * first[label] - np.array(flux, dtype=np.float32).astype(float)
        assert r["lnlike"] == pytest.approx(noise.lnlike_correlated_np(residual, cov))


def test_running_sums_by_bins(spark):
    """One number as the order, with an uneven spread and a null."""
    rng = np.random.default_rng(5)
    rows = [("a", float(x), int(w)) for x, w in zip(rng.lognormal(0, 3, 500), rng.integers(0, 9, 500), strict=True)] + [("a", None, 4), ("b", 1.0, 2)]
    df = spark.createDataFrame(rows, "p string, x double, w long").repartition(4)
    out = diagnostics.running(df, ["p"], ["x"], F.col("w"), "upto", "all", bins=64)
    assert out.columns == ["p", "x", "w", "upto", "all"]
    got = sorted(((r["x"] if r["x"] is not None else -1.0, r["upto"], r["all"]) for r in out.where("p = 'a'").collect()))
    mine = sorted(((x if x is not None else -1.0), w) for p, x, w in rows if p == "a")
    assert got == [(x, int(c), sum(w for _, w in mine)) for (x, _), c in zip(mine, np.cumsum([w for _, w in mine]), strict=True)]
    drawn = diagnostics.systematic_resample(df.where("x IS NOT NULL"), ["p"], "w", ["x"], 50, F.lit(0.5))
    assert drawn.columns == ["p", "x", "w", "draw"] and {r["p"]: r["n"] for r in drawn.groupBy("p").agg(F.count("*").alias("n")).collect()} == {"a": 50, "b": 50}


@pytest.mark.parametrize("op", sorted(models.OPERATORS))
def test_combined_models_are_merged_not_broadcast(spark, op):
    """Rows that a grid adds aren't in Spark's estimate, which would send either side to the driver."""
    rows = spark.range(5).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("g"))
    a, b = rows.select("id", "g", (F.col("id") + 0.5).alias("flux")), rows.where("id > 0").select("id", "g", (F.col("g") - 2.0).alias("flux"))
    out = models.combine(a, b, op, ["id", "g"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    expected = {(i, g): None if op == "/" and g == 2 else models.OPERATORS[op](i + 0.5, g - 2.0) for i in range(1, 5) for g in range(1, 4)}
    assert {(r["id"], r["g"]): r["flux"] for r in out.collect()} == expected and out.count() == len(expected)
