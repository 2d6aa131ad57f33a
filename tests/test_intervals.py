import math
import random

from pyspark.sql import functions as F
from quaver.operators import intervals
from quaver.plans import spans as plans


def spans(rng, n, longest, reach=1000):
    out = [(i, s, s + rng.randint(0, longest)) for i, s in enumerate(rng.choices(range(reach), k=n))]
    return out + [(n, -50, reach + 50)] * (rng.random() < 0.3)


def frame(spark, rows):
    return spark.createDataFrame(rows, "seg_id long, start long, end long")


def disjoint(rng, n, gap=20, longest=40):
    at, out = rng.randint(-30, 0), []
    for i in range(n):
        at += rng.randint(0, gap)
        out.append((i, at, at + rng.randint(1, longest)))
        at = out[-1][2]
    return out


def test_sweeps_equal_nested_loops(spark):
    rng = random.Random(4)
    for longest in (3, 60, 900):
        inner, outer = spans(rng, 80, 40), spans(rng, 60, longest)
        got = {tuple(r) for r in intervals.first_containing(frame(spark, inner + [(99, None, 5)]), frame(spark, outer + [(98, 5, None), (97, 9, 3)])).collect()}
        first = lambda s, e: min(((os, i) for i, os, oe in outer if os <= s and oe >= e), default=(0, None))[1]
        assert got == {(i, s, e, first(s, e)) for i, s, e in inner} | {(99, None, 5, None)}
        places = [rng.randint(-80, 1100) for _ in range(150)] + [None, 7, 7]
        points = spark.createDataFrame([(p, "x") for p in places], "at long, start string")
        got = sorted(r["at"] for r in intervals.points_in(points, frame(spark, outer + [(98, None, None)]), "at").collect())
        assert got == sorted(p for p in places if p is not None and any(s <= p <= e for _, s, e in outer))
        a, b = disjoint(rng, 40), disjoint(rng, 40, longest=longest)
        left, right = frame(spark, a).withColumnRenamed("seg_id", "left_id"), frame(spark, b).withColumnRenamed("seg_id", "right_id")
        for least in (1, 6):
            got = sorted(map(tuple, intervals.intersect(left, right, least).collect()))
            assert got == sorted((i, j, max(s, t), min(e, f)) for i, s, e in a for j, t, f in b if min(e, f) - max(s, t) >= least)
        got = sorted(map(tuple, intervals.subtract(frame(spark, a), frame(spark, outer), 2).collect()))
        free = []
        for _, s, e in a:
            cells = [not any(os <= t and t + 1 <= oe for _, os, oe in outer) for t in range(s, e)]
            runs, begun = [], None
            for k, c in enumerate(cells + [False]):
                inside = any(os < s + k < oe for _, os, oe in outer) or any(os == oe == s + k for _, os, oe in outer)
                if begun is not None and (not c or inside):
                    runs.append((s + begun, s + k))
                    begun = None
                if c and begun is None:
                    begun = k
            free += [r for r in runs if r[1] - r[0] > 2]
        assert got == sorted(free)


def test_bands_of_null_and_repeated_points(spark):
    points = spark.createDataFrame([(None, 100), (1, 100), (1, 100), (2, None), (3, -101)], "inj_id long, tc long")
    events = spark.createDataFrame([(110, 2.0), (90, 3.0), (111, 9.0), (None, 99.0), (95, None), (-100, -1.0)], "time long, stat double")
    got = sorted(map(tuple, intervals.band_max(points, "tc", events, 10).collect()), key=str)
    assert got == sorted([(None, 100, 3.0), (1, 100, 3.0), (1, 100, 3.0), (2, None, -math.inf), (3, -101, -1.0)], key=str)


def test_lists_that_overlap_are_told(spark):
    rows = frame(spark, [(0, 0, 5), (1, 5, 9), (2, 8, 12), (3, 20, 30), (4, 22, 23)])
    assert sorted(r["seg_id"] for r in intervals.overlapping(rows).collect()) == [2, 4]
    assert intervals.overlapping(rows.limit(0)).count() == 0


def test_all_overlapping_pairs_of_two_lists(spark):
    rng = random.Random(6)
    for longest, width in ((3, 7), (60, 25), (900, 200)):
        a, b = spans(rng, 120, longest), spans(rng, 90, longest)
        left, right = frame(spark, a + [(500, None, 5), (501, 9, 3)]).withColumnRenamed("seg_id", "left_id"), frame(spark, b).withColumnRenamed("seg_id", "right_id")
        want = sorted((i, j, max(s, t), min(e, f)) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f))
        for tile in (5, 4096):
            assert sorted(map(tuple, intervals.overlaps(left, right, width, tile).collect())) == want


def test_every_user_is_intersected(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{h}:{m}:00", user, "view", 1.0) for i, (user, h, m) in enumerate((u, h, m) for u, h, m in [(1, 0, 10), (1, 0, 40), (3, 0, 20), (3, 1, 30), (2, 0, 30), (2, 1, 0), (4, 0, 35), (4, 0, 50), (5, 3, 10)])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"file://{tmp_path}/events.parquet")
    got = plans.QUERIES["interval_intersect"](spark, f"file://{tmp_path}").collect()
    assert sorted((r["left_id"] // 1000000, r["right_id"] // 1000000, (r["end"] - r["start"]) // 60_000_000) for r in got) == [(1, 2, 10), (1, 4, 5), (3, 2, 30), (3, 4, 15)]
