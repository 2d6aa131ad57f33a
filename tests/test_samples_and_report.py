import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaver.functions import astro
from quaver.operators import intervals, report, samples
from quaver.sinks import dataset
from quaver.sinks import files as sinks
from quaver.sources import files as sources


def test_samples_by_manifest(spark):
    rng = random.Random(2)
    data = {(d, s): [rng.random() for _ in range(50 + s)] for d in ("H1", "L1") for s in range(3)}
    blocks = spark.createDataFrame([(d, s, b, v[b * 8 : b * 8 + 8]) for (d, s), v in data.items() for b in range(-(-len(v) // 8))], "det string, seg long, block long, samples array<double>")
    rows = [(f"{i}", rng.choice("HL") + "1", rng.randrange(3), rng.randrange(60), rng.randrange(30)) for i in range(60)] + [("x", "V1", 0, 0, 5), ("y", "H1", None, 0, 5)]
    manifest = spark.createDataFrame(rows, "sample_id string, det string, seg long, begin long, n long")
    got = {r["sample_id"]: r["samples"] for r in samples.gathered(manifest, blocks, 8).collect()}
    assert got == {i: data.get((d, s), [])[b : b + n] for i, d, s, b, n in rows}
    assert samples.gathered(manifest.limit(0), blocks, 8).count() == 0


def pairs(spark, n=200):
    rows = [(i, i // 32, int(i % 3 == 0), [float(i)], [i + 0.5]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, batch long, target int, H1 array<double>, L1 array<double>")


def test_noise_is_dealt_anew_within_batches(spark):
    out = samples.repaired(pairs(spark), "id", "batch", F.col("target") == 0, ["H1", "L1"], 5).collect()
    assert sorted(r["id"] for r in out) == list(range(200))
    for r in out:
        assert (r["H1"], r["L1"]) == ([float(r["H1_from"])], [r["L1_from"] + 0.5])
        assert r["H1_from"] // 32 == r["batch"] == r["L1_from"] // 32
        assert r["target"] == 0 or r["H1_from"] == r["id"] == r["L1_from"]
    noise = [r for r in out if r["target"] == 0]
    for side in ("H1_from", "L1_from"):
        assert sorted(r[side] for r in noise) == sorted(r["id"] for r in noise)
    assert sum(r["H1_from"] == r["L1_from"] for r in noise) < 30


def test_pairs_that_no_source_makes(spark):
    rows = pairs(spark, 600)
    out = samples.cross_paired(rows, "id", F.col("target") == 1, "H1", "L1", 5, 0.5, 0.5).collect()
    assert 150 < len(out) < 250 and {r["kind"] for r in out} == {"both", "H1", "L1"}
    for r in out:
        assert r["id"] % 3 and (r["H1"], r["L1"]) == ([float(r["H1_from"])], [r["L1_from"] + 0.5])
        signals = {"both": (True, True), "H1": (True, False), "L1": (False, True)}[r["kind"]]
        assert tuple(x % 3 == 0 for x in (r["H1_from"], r["L1_from"])) == signals and r["H1_from"] != r["L1_from"]
        assert all(x == r["id"] or s for x, s in zip((r["H1_from"], r["L1_from"]), signals))
    assert samples.cross_paired(rows.where("target = 0"), "id", F.col("target") == 1, "H1", "L1", 5, 0.5, 0.5).count() == 0
    one = samples.cross_paired(rows.where("target = 0 or id = 3"), "id", F.col("target") == 1, "H1", "L1", 5, 1.0, 1.0)
    assert {r["kind"] for r in one.collect()} == {"H1", "L1"}


def test_signals_at_a_target_ratio(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0], 5.0, 20.0, 100.0), (2, [0.0], 0.0, 20.0, 100.0)], "id long, a array<double>, own double, mc double, distance double")
    out = {r["id"]: r for r in samples.rescaled(rows, ["a"], F.col("own"), F.lit(10.0)).collect()}
    assert (out[1]["a"], out[1]["snr"], out[1]["distance"]) == ([6.0, 8.0], 10.0, 50.0) and out[2]["a"] == [None]
    back = spark.createDataFrame([out[1]], "id long, a array<double>, own double, mc double, distance double, snr double, dchirp double")
    assert np.isclose(back.select(astro.distance(F.col("dchirp"), F.col("mc"))).first()[0], 50.0)
    far = samples.moved(rows, ["a"], F.lit(200.0)).where("id = 1").first()
    assert np.allclose(np.array(far["a"]) * far["distance"], [300.0, 400.0])


def test_shares_and_bands_equal_direct_counts(spark):
    rng = np.random.default_rng(6)
    s, t, p = np.round(rng.normal(0, 2, 800), 1), rng.integers(0, 2, 800), rng.integers(0, 9, 800).astype(float)
    s = s + t
    rows = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(s, t, p)] + [(0.5, 1, None)], "score double, target int, p double")
    got = {(r["bin"], r["score"]): r["fraction"] for r in report.detected_by_bin(rows, "p").collect()}
    edges, want = [0, 2, 4, 6, 8], {}
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        own = s[(t == 1) & (p > a) & (p < b)]
        want |= {(i, float(x)): float((own > x).mean()) for x in np.unique(s[t == 0])}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    bands = report.score_bands(rows)
    sig, top = np.r_[s[t == 1], 0.5], s[t == 0].max()
    assert bands[3] == (top, sig.max()) and bands[0] == (sig.min(), 0.0)
    hist = {}
    for r in report.banded_histograms(rows, ["p"], 10).collect():
        hist.setdefault(r["band"], np.zeros(10))[r["bin"]] = r["n"]
    for k, (a, b) in {-1: (-99, 99), **bands}.items():
        inside = p[(t == 1) & (s > a) & (s < b)]
        assert (np.histogram(inside, 10)[0] == hist.get(k, np.zeros(10))).all() if len(inside) else k not in hist
    assert report.detected_by_bin(rows.limit(0), "p").count() == 0 and report.banded_histograms(rows.limit(0), ["p"]).count() == 0


def test_vetoes_numbers_and_stored_slices(spark, tmp_path):
    rng = random.Random(1)
    spans = [(i, s, s + rng.randint(0, 30)) for i, s in enumerate(rng.choices(range(300), k=40))]
    places = [rng.randint(-20, 350) for _ in range(12)]
    seg, points = spark.createDataFrame(spans, "seg_id long, start long, end long"), spark.createDataFrame([(p,) for p in [*places, None]], "at long")
    assert sorted(r["seg_id"] for r in intervals.holding(seg, points, "at").collect()) == [i for i, s, e in spans if any(s <= p <= e for p in places)]
    order = sorted(spans, key=lambda x: (x[1], x[0]))
    assert {r["seg_id"]: r["number"] for r in intervals.numbered(seg).collect()} == {x[0]: k for k, x in enumerate(order)}
    blocks = spark.createDataFrame([(d, s, b, [float(b)]) for d in ("H1", "L1") for s in range(4) for b in range(6)], "det string, seg long, block long, samples array<double>")
    sinks.write_blocks(blocks, f"file://{tmp_path}/s")
    part = sources.read_blocks(spark, f"file://{tmp_path}/s", ["H1"], (1, 2), (2, 4))
    assert sorted((r["det"], r["seg"], r["block"]) for r in part.collect()) == [("H1", s, b) for s in (1, 2) for b in (2, 3, 4)]
    assert "PartitionFilters: [" in (plan := part._jdf.queryExecution().toString()) and "det" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_data_set_in_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, int(i % 4 == 0), [float(i)], "x") for i in range(90)], "id long, target int, a array<double>, path string")
    where = f"file://{tmp_path}/d"
    dataset.write_dataset(rows, where, "id", "target", 10, 3)
    lookup = sources.read_lookup(spark, where)
    found = sources.read_samples(spark, where, lookup).collect()
    assert sorted(r["id"] for r in found) == list(range(90)) and all(r["a"] == [float(r["id"])] for r in found)
    sizes = {}
    for r in found:
        sizes.setdefault(r["path"], []).append(r["row"])
    assert sorted(map(len, sizes.values())) == [3, 7, 10, 10, 10, 10, 10, 10, 10, 10] and all(sorted(v) == list(range(len(v))) for v in sizes.values())
    some = sources.read_samples(spark, where, lookup.where("id in (8, 9)")).collect()
    assert {(r["id"], r["target"]) for r in some} == {(8, 1), (9, 0)}
    with pytest.raises(Exception, match="already exists"):
        dataset.write_dataset(rows, where, "id", "target", 10, 3)
