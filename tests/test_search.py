"""Rules for ties, clamps and empty tables, and each query against its SQL."""

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from quaver import registry
from quaver.operators import intervals, search, tables

SF = "/root/testdata/sf0.001"
TRIGGER = "event_id long, time long, stat double"


@pytest.mark.parametrize("name", ["trigger_clusters", "foreground_far", "sensitive_volume_plain", "interval_subtract", "raw_segment_lookup", "rolling_mean_500", "stratified_split", "ntile_chunks", "array_normalise"])
def test_sql(spark, name):
    frame = registry.QUERIES[name](spark, SF)
    assert frame.count() > 0
    assert differences(frame, connect(SF), registry.ORACLES[name]) == ""


def test_nearest_injection_ties_and_ends(spark):
    events = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate([-5, 5, 10, 15, 25])], TRIGGER)
    injections = spark.createDataFrame([(0, 0), (1, 10), (2, 20)], "inj_id long, tc long")
    rows = sorted((r.event_id, r.inj_id, r.dt) for r in search.nearest_injection(events, injections).collect())
    assert rows == [(0, 0, 5), (1, 1, 5), (2, 1, 0), (3, 2, 5), (4, 2, 5)]
    assert search.nearest_injection(events, injections.limit(0)).where("inj_id is not null").count() == 0


def test_clusters_equality_does_not_split_and_first_maximum_wins(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (2, 10, 3.0), (3, 20, 3.0), (4, 31, 2.0)], TRIGGER)
    got = sorted((r.event_id, r.n) for r in search.clusters(rows, 10).collect())
    assert got == [(2, 3), (4, 1)]
    assert search.clusters(rows.limit(0), 10).count() == 0


def test_far_of_ties(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 3.0)], "event_id long, stat double")
    assert sorted((r.event_id, r.far) for r in search.false_alarm_rates(rows, 10.0).collect()) == [(1, 0.0), (2, 0.1), (3, 0.2)]


def test_found_is_strictly_louder(spark):
    noise = spark.createDataFrame([(1, 5.0)], "event_id long, stat double")
    found = spark.createDataFrame([(5.0, 8.0), (6.0, 8.0)], "stat double, mc double")
    assert search.found_curve(noise, found).first()["n"] == 1


def test_intervals(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "start long, end long")

    def got(df):
        return sorted(map(tuple, df.select("start", "end").collect()))

    assert got(intervals.coalesce(frame([(0, 5), (5, 7), (1, 2), (9, 9), (20, 30)]))) == [(0, 7), (9, 9), (20, 30)]
    left = frame([(0, 100), (200, 300)])
    assert got(intervals.subtract(left, frame([(-5, 10), (50, 60), (55, 70), (90, 120)]), 0)) == [(10, 50), (70, 90), (200, 300)]
    assert got(intervals.subtract(left, frame([(-5, 500)]), 0)) == []


def test_chunks_and_histogram(spark):
    rows = spark.range(13).withColumnRenamed("id", "k")
    sizes = sorted((r.chunk, r["count"]) for r in tables.chunks(rows, "k", 5).groupBy("chunk").count().collect())
    assert [n for _, n in sizes] == [3, 3, 3, 2, 2]
    assert dict(map(tuple, tables.histogram(rows, "k", 4).collect())) == {0: 3, 1: 3, 2: 3, 3: 4}


def test_sides_of_odd_rows_without_a_join(spark):
    rows = [(0, 5, "a"), (1, 5, "a"), (0, 5, None), (0, 5, None), (1, None, None), (0, None, None), (1, 6, "b"), (None, 7, "x"), (-1, 8, "x")]
    df = spark.createDataFrame(rows, "team long, hour long, kind string")
    got = tables.sides(df, F.col("team") == 0, F.col("team") == 1, ["hour", "kind"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, "a", "both"), (5, None, "first"), (None, None, "both"), (6, "b", "second")], key=str)
    for name in ("unique_pairs", "unique_values", "unique_ratio_bins"):
        frame = registry.QUERIES[name](spark, SF)
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
        assert differences(frame, connect(SF), registry.ORACLES[name]) == ""
