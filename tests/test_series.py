import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaver.operators import series


def make(rng, lengths, size):
    data = {key: [round(rng.uniform(-9, 9), 2) for _ in range(n)] for key, n in lengths.items()}
    rows = [(det, seg, b, v[b * size : (b + 1) * size]) for (det, seg), v in data.items() for b in range(-(-len(v) // size))]
    rng.shuffle(rows)
    return data, rows


SCHEMA = "det string, seg long, block long, samples array<double>"


@pytest.mark.parametrize("size,step,span", [(8, 3, 7), (8, 5, 30), (16, 16, 16), (4, 1, 9), (50, 7, 3)])
def test_windows_across_block_borders(spark, size, step, span):
    rng = random.Random(size * span)
    data, rows = make(rng, {("H1", 3): 50, ("L1", 3): 47, ("H1", 10): 33, ("L1", 10): 64, ("H1", 2): span - 1, ("L1", 2): 40, ("H1", 7): 60, ("V1", 7): 60}, size)
    want, index = [], 0
    for seg in (2, 3, 10):
        n = min(len(data["H1", seg]), len(data["L1", seg]))
        for k in range(max(0, (n - span) // step)):
            want.append((index, seg, k, data["H1", seg][k * step : k * step + span], data["L1", seg][k * step : k * step + span]))
            index += 1
    for dealt in (rows, rows[::-1]):
        got = series.windows(spark.createDataFrame(dealt, SCHEMA).repartition(3), ["H1", "L1"], size, step, span).orderBy("index").collect()
        assert [tuple(r) for r in got] == want
    assert series.windows(spark.createDataFrame([], SCHEMA), ["H1", "L1"], size, step, span).count() == 0


def test_blocks_of_rows_and_numbers_of_windows(spark):
    rows = [("H1", i % 3, i * 7 % 101, float(i)) for i in range(101)] + [("L1", 0, 5, None), ("L1", None, 1, 2.0)]
    got = series.blocks_of(spark.createDataFrame(rows, "det string, seg long, at long, x double"), "at", "x", 8).collect()
    for seg in range(3):
        blocks = sorted((r["block"], r["samples"]) for r in got if (r["det"], r["seg"]) == ("H1", seg))
        assert all(len(s) == 8 for _, s in blocks[:-1])
        assert [x for _, s in blocks for x in s] == [v for _, v in sorted((r[2], r[3]) for r in rows if r[:2] == ("H1", seg))]
    rest = {(r["seg"], tuple(r["samples"])) for r in got if r["det"] == "L1"}
    assert rest == {(0, (None,)), (None, (2.0,))}
    plan = spark.createDataFrame([(5, 3, 0), (6, 0, 3), (9, 2, 3)], "seg long, windows long, first long")
    asked = spark.createDataFrame([(i, "x") for i in (-1, 0, 2, 3, 4, 5, 2, None)], "index long, seg string").drop("seg")
    got = sorted((r["index"], r["seg"], r["k"]) for r in series.locate(asked, plan).collect() if r["index"] is not None)
    assert got == [(-1, None, None), (0, 5, 0), (2, 5, 2), (2, 5, 2), (3, 9, 0), (4, 9, 1), (5, None, None)]


def test_scores_of_a_model(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 0.0]), (2, [0.5, 0.0], [0.0, 0.0])], "index long, H1 array<double>, L1 array<double>")
    out = series.scored(rows, lambda m: np.einsum("ij,ij->i", m["H1"], m["L1"]), ["H1", "L1"]).collect()
    assert sorted(map(tuple, out)) == [(1, 3.0), (2, 0.0)]
    assert series.scored(rows.limit(0), lambda m: m["H1"].sum(axis=1), ["H1", "L1"]).columns == ["index", "raw"]


@pytest.mark.parametrize("mode", list(series.MODES))
def test_slides_move_within_their_series(spark, mode):
    rng = random.Random(3)
    size, dets, starts = 8, ["H1", "L1", "V1"], {}
    data, rows = make(rng, {(d, s): 60 + 9 * i + s for i, d in enumerate(dets) for s in range(6)} | {("H1", 9): 50, ("L1", 9): 50}, size)
    blocks = spark.createDataFrame(rows, SCHEMA)
    extents = series.lengths(blocks).withColumn("start", (F.ascii("det") + F.col("seg")) % 5)
    for r in extents.collect():
        starts[r["det"], r["seg"]] = r["start"]
    plan = series.slide_plan(extents, dets, mode, 5, 40)
    begins = {(r["det"], r["seg"]): (r["begin"], r["n"]) for r in plan.collect()}
    assert begins.keys() == {(d, s) for d in dets for s in range(6)}
    shifts = {}
    for (d, s), (begin, n) in begins.items():
        home = max(starts[e, s] for e in dets) - starts[d, s]
        assert n == 40 and 0 <= begin and begin + n <= len(data[d, s])
        shifts[d, s] = begin - home
    if mode == "none":
        assert set(shifts.values()) == {0}
    if mode == "all_but_first":
        assert {v for (d, _), v in shifts.items() if d == "H1"} == {0} and len(set(shifts.values())) > 4
    if mode == "first_and_rest":
        assert all(shifts["L1", s] == shifts["V1", s] for s in range(6)) and len(set(shifts.values())) > 4
    cut = series.cut(blocks, plan, size).collect()
    for (d, s), (begin, n) in begins.items():
        parts = sorted((r["block"], r["samples"]) for r in cut if (r["det"], r["seg"]) == (d, s))
        assert [x for _, p in parts for x in p] == data[d, s][begin : begin + n] and all(len(p) == size for _, p in parts[:-1])
    both = series.aligned(series.cut(blocks, plan, size), dets)
    assert both.count() == 6 * 5
    assert series.slide_plan(extents, dets, mode, 5, 10_000).count() == 0
    assert series.slide_plan(extents, dets, mode, 5).count() == 18


def test_injections_laid_over_segments(spark):
    segments = [(0, 1, 6), (1, 8, 15), (2, 20, 20), (3, 30, 40)]
    injections = [(i, i) for i in range(-1, 24)] + [(50, 5), (51, None)]
    seg, inj = spark.createDataFrame(segments, "seg_id long, start long, end long"), spark.createDataFrame(injections, "inj_id long, tc long")
    for before, after in ((0, 0), (1, 2), (3, 4)):
        want, passed = [], 0
        for s, a, b in segments:
            moved = [(i, s, t + a - passed + before) for i, t in injections if t is not None]
            want += [m for m in moved if a + before <= m[2] <= b - after]
            passed += b - a
        assert sorted(map(tuple, series.shifted_injections(inj, seg, before, after).collect())) == sorted(want)
