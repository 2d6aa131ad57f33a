import math

import pytest
from pyspark.sql import functions as F
from quaver.operators import counters, draws, intervals, search, tables
from quaver.sinks import files as sinks
from quaver.sources import files as sources


def test_round_trips(spark, tmp_path):
    at = f"file://{tmp_path}"
    events = spark.createDataFrame([(1.0, 2.0, 0.3), (2.0, None, 0.3)], "time double, stat double, var double")
    sinks.write_events(events.withColumn("more", F.lit(1)), f"{at}/a")
    sinks.write_events(events, f"{at}/b")
    assert sources.read_events(spark, [f"{at}/a", f"{at}/b"]).count() == 4
    with pytest.raises(Exception, match="already exists"):
        sinks.write_events(events, f"{at}/a")
    sinks.write_evaluation(events, f"{at}/e")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_evaluation(events, f"{at}/e")
    sinks.write_evaluation(events.limit(1), f"{at}/e", force=True)
    assert spark.read.parquet(f"{at}/e").count() == 1
    blocks = spark.createDataFrame([("H1", 5, [1.0]), ("L1", 5, [2.0])], "det string, seg long, samples array<double>")
    sinks.write_blocks(blocks, f"{at}/blocks")
    assert spark.read.parquet(f"{at}/blocks").where("det = 'L1' and seg = 5").first()["samples"] == [2.0]
    segments = spark.createDataFrame([(0, 10, 20), (1, 30, 44)], "seg_id int, start long, end long")
    sinks.write_segments(segments, f"{at}/segments")
    assert sorted(map(tuple, sources.read_segments(spark, f"{at}/segments").collect())) == [(0, 10, 20), (1, 30, 44)]
    for epoch in (1, 2):
        sinks.append_log(spark.createDataFrame([(epoch, 0.5 / epoch)], "epoch int, loss double"), f"{at}/log")
    assert sorted(map(tuple, sources.read_log(spark, f"{at}/log", "epoch int, loss double").collect())) == [(1, 0.5), (2, 0.25)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "ranges.txt").write_text("# start end\n10.0  20\n  30\t40 x\n\n7\n")
    assert sorted(map(tuple, sources.read_ranges(spark, f"file://{tmp_path}/ranges.txt").collect())) == [(10, 20), (30, 40)]
    (tmp_path / "glitches.csv").write_text("ifo,label,event_time\nH1,Blip,1.5\nL1,Tomte,\n")
    assert sorted(map(tuple, sources.read_catalogue(spark, f"file://{tmp_path}/glitches.csv").collect()), key=str) == [(1.5, "H1"), (None, "L1")]


def test_repeated_and_null_triggers_stay(spark):
    triggers = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (None, 15, 2.0), (3, None, 3.0)], "event_id long, time long, stat double")
    injections = spark.createDataFrame([(7, 0), (8, 10), (9, 20)], "inj_id long, tc long")
    got = sorted(map(tuple, search.nearest_injection(triggers, injections).collect()), key=str)
    assert got == [(1, 5, 1.0, 8, 5), (1, 5, 1.0, 8, 5), (3, None, 3.0, None, None), (None, 15, 2.0, 9, 5)]
    assert {tuple(r)[3:] for r in search.nearest_injection(triggers, injections.limit(0)).collect()} == {(None, None)}


def test_band_without_events_is_minus_infinity(spark):
    points = spark.createDataFrame([(1, 100), (2, 900)], "inj_id long, tc long")
    events = spark.createDataFrame([(110, 2.0), (90, 3.0), (111, 9.0)], "time long, stat double")
    assert {tuple(r) for r in intervals.band_max(points, "tc", events, 10).collect()} == {(1, 100, 3.0), (2, 900, -math.inf)}


def test_draws_and_edges(spark):
    rows = spark.range(20_000).select(F.col("id"), counters.uniform(F.col("id"), 3).alias("u"), counters.uniform(F.col("id"), 4).alias("v"))
    m1, m2 = draws.ordered_masses(F.col("u"), F.col("v"), 7.0, 50.0)
    r = rows.agg(F.avg("u").alias("u"), F.min(m1 - m2).alias("gap"), F.avg((draws.uniform_radius(F.col("u"), 1.0, 2.0) < 1.5).cast("int")).alias("near"), F.avg(draws.sky_position(F.col("u"), F.col("v"))[1]).alias("dec")).first()
    assert abs(r["u"] - 0.5) < 0.02 and r["gap"] >= 0 and abs(r["near"] - (1.5**3 - 1) / 7) < 0.02 and abs(r["dec"]) < 0.03
    epochs = spark.range(6).select(F.col("id").alias("e"))
    assert [round(x[0], 6) for x in epochs.orderBy("e").select(draws.annealed(epochs, "e", 1, 4, 0.0, 1.0)).collect()] == [0, 0, 0.5, 1, 1, 1]
    values = spark.createDataFrame([(x,) for x in (0.0, 1.0, 3.9, 4.0, 8.0, None)], "x double")
    assert {tuple(r) for r in tables.histogram_of_edges(values, "x", 3).collect()} == {(0, 0, 4, 3), (1, 4, 8, 2)}
    assert tables.histogram_of_edges(values.limit(0), "x", 3).count() == 0
    losses = spark.createDataFrame([(1, 3.0), (2, 4.0), (3, 2.0)], "e int, loss double")
    assert [tuple(r)[2:] for r in tables.best_so_far(losses, "e", "loss").orderBy("e").collect()] == [(3.0, True), (3.0, False), (2.0, True)]
