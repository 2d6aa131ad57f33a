import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaver.functions import sky
from quaver.operators import curation, draws
from quaver.plans.curation import SPEC
from quaver.sources import priors


def test_a_specification_is_drawn_until_it_holds(spark, tmp_path):
    spec = priors.parsed(SPEC)
    assert spec.variables[:2] == ("mass1", "mass2") and spec.static == {"f_lower": "20.0"} and spec.constraints == ("mass2 <= mass1",)
    ids = spark.range(800).withColumn("mass9", F.lit("kept"))
    rows = priors.drawn(ids, "id", spec, 3).toPandas()
    assert len(rows) == 800 and (rows["mass2"] <= rows["mass1"]).all() and set(rows["mass9"]) == {"kept"}
    assert abs(rows["trial"].mean() - 1) < 0.2 and rows["trial"].max() > 5
    assert abs(np.sin(rows["dec"]).mean()) < 0.06 and abs(np.cos(rows["spin1_polar"]).mean()) < 0.06 and abs((rows["chirp_distance"] ** 3).mean() / (130**3 + 350**3) * 2 - 1) < 0.05
    size = np.sqrt(rows["spin1x"] ** 2 + rows["spin1y"] ** 2 + rows["spin1z"] ** 2)
    assert np.allclose(size, rows["spin1_a"]) and np.allclose(rows["q"], rows["mass1"] / rows["mass2"])
    # Rounds of another size take the same draws.
    other = priors.drawn(ids, "id", spec, 3, trials=1).select("id", "trial").collect()
    assert {tuple(r) for r in other} == set(zip(rows["id"], rows["trial"]))
    (tmp_path / "a.ini").write_text(SPEC)
    assert priors.read_spec(spark, f"file://{tmp_path}/a.ini") == spec
    assert priors.drawn(ids.limit(0), "id", spec, 3).count() == 0
    for wrong in ("[variable_params]\nx =\n", "[variable_params]\nx =\n[prior-x]\nname = odd\n"):
        with pytest.raises(ValueError):
            priors.parsed(wrong)


def test_antennas_by_their_averages(spark):
    rows = spark.range(40_000).select(*draws.sky_position(F.rand(1), F.rand(2)), (F.rand(3) * 2 * math.pi).alias("psi")).toDF("ra", "dec", "psi")
    at = [F.col("ra"), F.col("dec")]
    for det in sky.RESPONSES:
        plus, cross = sky.antenna(det, *at, F.col("psi"), F.lit(0.3))
        r = rows.agg(F.avg(plus * plus), F.avg(cross * cross), F.max(plus * plus + cross * cross)).first()
        # Two arms at a right angle: a fifth for each polarisation, and one at best.
        assert abs(r[0] - 0.2) < 0.005 and abs(r[1] - 0.2) < 0.005 and 0.98 < r[2] <= 1.001
        tensor, place = np.array(sky.RESPONSES[det]), np.array(sky.PLACES[det])
        assert np.allclose(tensor, tensor.T) and abs(np.trace(tensor)) < 1e-5 and abs(np.linalg.norm(place) - 6.371e6) < 2e4
    apart = rows.agg(F.max(F.abs(sky.delay("H1", *at, F.lit(0.3)) - sky.delay("L1", *at, F.lit(0.3))))).first()[0]
    assert abs(apart - 0.01001) < 1e-4
    one = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 2.0, 0.0])], "p array<double>, c array<double>")
    got = one.select(sky.projected(F.col("p"), F.col("c"), (F.lit(1.0), F.lit(0.5)), F.lit(-1))).first()[0]
    assert got == [0.0, 1.0, 0.0, 1.0]


def test_noise_is_added_in_a_drawn_order(spark):
    signals = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(7)], "id long, a array<double>")
    noise = spark.createDataFrame([(100 + i, [10.0 * i, 0.0]) for i in range(3)], "id long, a array<double>")
    out = curation.with_noise(signals, noise, "id", ["a"], 4).collect()
    assert sorted(r["id"] for r in out) == list(range(7)) and sorted(r["noise_id"] for r in out).count(100) >= 2
    assert all(r["a"] == [1.0 + 10.0 * (r["noise_id"] - 100), 2.0] for r in out)
    assert curation.with_noise(signals, noise.limit(0), "id", ["a"], 4).count() == 0
    orders = [[r["id"] for r in curation.shuffled(signals, "id", s).orderBy("place").collect()] for s in (1, 2)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(7)) and orders[0] != orders[1]


def test_cuts_paths_and_bests(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(11)] + [(None, 5.0), (None, None), ("b", float("nan"))], "k string, v double")
    kept = curation.below_percentile(rows, ["k"], "v", 0.8).collect()
    assert sorted(r["v"] for r in kept if r["k"] == "a") == [float(i) for i in range(9)] and [r["v"] for r in kept if r["k"] is None] == [5.0]
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 3.0, 5.0), (2, 1, 9.0, 9.0), (3, 1, 0.0, 0.0), (3, 2, 1.0, 0.0)], "g long, o long, x double, y double")
    assert {tuple(r) for r in curation.path_lengths(points, "g", ["o"], ["x", "y"]).collect()} == {(1, 3, 6.0), (2, 1, 0.0), (3, 2, 1.0)}
    epochs = spark.createDataFrame([(1, 3.0, 0.1), (2, None, 0.4), (3, 2.0, 0.2), (4, 2.0, 0.5)], "e int, loss double, acc double")
    got = [tuple(r) for r in curation.bests_so_far(epochs, "e", {"loss": "min", "acc": "max"}).orderBy("e").collect()]
    assert got == [(1, 3.0, True, 0.1, True), (2, 3.0, False, 0.4, True), (3, 2.0, True, 0.4, False), (4, 2.0, False, 0.5, True)]
    arrays = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, None), (4, []), (5, [None])], "i int, a array<double>")
    assert [r["i"] for r in arrays.where(curation.finite(F.col("a"))).collect()] == [1]
    blocks = spark.createDataFrame([("H1", 1, 0, [1.0, 2.0]), ("V1", 1, 0, [3.0]), ("L1", 2, 0, [4.0])], "det string, seg long, block long, samples array<double>")
    assert sorted(map(tuple, curation.zero_filled(blocks, ["H1", "L1"]).collect())) == [(1, 0, [1.0, 2.0], [0.0, 0.0]), (2, 0, [0.0], [4.0])]
    scores = spark.createDataFrame([(800.0, 0.0), (-800.0, 0.0), (0.0, 1.0), (3.0, None)], "x double, t double")
    assert np.isclose(scores.agg(curation.cross_entropy(F.col("x"), F.col("t"))).first()[0], (800 + 0 + math.log(2)) / 3)
    assert {tuple(r) for r in curation.histograms(epochs, ["loss", "e"], 2).collect()} == {("loss", 0, 2), ("loss", 1, 1), ("e", 0, 2), ("e", 1, 2)}
    assert curation.histograms(epochs.limit(0), ["loss"], 2).count() == 0
