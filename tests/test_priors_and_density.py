import math

import numpy as np
from pyspark.sql import functions as F
from quaver.functions import astro, bounds
from quaver.operators import density, priors

T = bounds.Triangle()


def test_bounded_priors_stay_inside(spark):
    ids = spark.range(3000).withColumnRenamed("id", "inj")
    for kind in ("tau", "mchirp", "power_tau", "power_mchirp", "mchirp_q"):
        rows = priors.bounded(ids, "inj", kind, T, 5).withColumn("back", astro.duration(astro.chirp_mass(F.col("mass1"), F.col("mass2"))))
        r = np.array([tuple(x) for x in rows.select("mass1", "mass2", "q", "mchirp", "tau", "back").collect()])
        assert len(r) == 3000 and (r[:, 0] >= r[:, 1] - 1e-6).all() and r[:, 1].min() >= 7 - 1e-6 and r[:, 0].max() <= 50 + 1e-6
        assert np.allclose(r[:, 4], r[:, 5], rtol=1e-9) and np.allclose(r[:, 2], r[:, 0] / r[:, 1])
        low, high = T.durations if kind.endswith("tau") else T.chirp_masses
        share = ((r[:, 4] if kind.endswith("tau") else r[:, 3]) - low) / (high - low)
        assert abs(share.mean() - (1 / 3 if kind.startswith("power") else 1 / 2)) < 0.02
    narrow = priors.bounded(ids, "inj", "mchirp", T, 5, (20.0, 21.0)).agg(F.min("mchirp"), F.max("mchirp")).first()
    assert 20 - 1e-9 <= narrow[0] and narrow[1] <= 21 + 1e-9


def test_cubic_roots_against_a_solver(spark):
    cases = [(c, m) for c in (1e-6, 1e-3, 0.1, 4 / 27, 1.0, 50.0) for m in (0.01, 1.0, 7.0, 50.0)]
    rows = spark.createDataFrame(cases, "c double, m double").select("c", "m", bounds.cubic_root(F.col("c"), F.col("m")).alias("x")).collect()
    for r in rows:
        roots = np.roots([r["c"], 0, -1, -r["m"]])
        assert np.isclose(r["x"], max(z.real for z in roots if abs(z.imag) < 1e-6 * abs(z)), rtol=1e-6)


def test_rejection_takes_every_row_and_the_first_that_fits(spark):
    ids = spark.range(400)
    rows = priors.template_placement(ids, "id", T, 9)
    r = np.array([tuple(x) for x in rows.select("id", "trial", "tau0", "tau3", "mass1", "mass2").orderBy("id").collect()])
    assert len(r) == 400 and (r[:, 4] >= r[:, 5]).all() and r[:, 5].min() > 7 - 1e-6 and r[:, 4].max() < 50 + 1e-6
    assert abs(1 / (r[:, 1].mean() + 1) - 0.134) < 0.02 and (r[:, 1] > 31).any() or r[:, 1].max() > 10
    back = [T.tau0(a, b) for a, b in r[:, 4:6]], [T.tau3(a, b) for a, b in r[:, 4:6]]
    assert np.allclose(back[0], r[:, 2], rtol=1e-8) and np.allclose(back[1], r[:, 3], rtol=1e-8)
    # Rounds of another size find the same draws: trials count on.
    half = lambda x: x < 0.05
    one, two = [{(q["id"], q["trial"]) for q in priors.rejected_until_accepted(ids, "id", [0.0], [1.0], half, 4, k).collect()} for k in (4, 64)]
    assert one == two and len(one) == 400 and max(t for _, t in one) > 20
    assert priors.template_placement(ids.limit(0), "id", T, 9).count() == 0


def test_density_equals_direct_sums(spark):
    rng = np.random.default_rng(1)
    values = np.abs(rng.normal(0, 2, 5000)) + 1
    rows = spark.createDataFrame([(float(v), 1) for v in values] + [(None, 1), (float("nan"), 1), (float("inf"), 1)], "x double, i int").repartition(5)
    grid = [0.5, 1.0, 1.5, 3.0, 7.0, 9.0, 9.5]
    for low, high in ((1.0, 9.0), (1.0, None), (None, None)):
        got = {r["x"]: r["density"] for r in density.bounded_density(rows, "x", grid, low, high).collect()}
        h = values.std(ddof=1) * len(values) ** -0.2
        at = lambda x: np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        for x in grid:
            out = (low is not None and x < low) or (high is not None and x > high)
            want = 0 if out else at(x) + (at(2 * low - x) if low is not None else 0) + (at(2 * high - x) if high is not None else 0)
            assert np.isclose(got[x], want, rtol=1e-9)
    assert {r["density"] for r in density.bounded_density(rows.limit(0), "x", grid, 1.0).collect()} == {None}
    fine = np.linspace(1, 9, 400).tolist()
    total = sum(r["density"] for r in density.bounded_density(rows, "x", fine, 1.0, 9.0).collect()) * 8 / 399
    assert abs(total - 1) < 0.01
