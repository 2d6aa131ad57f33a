import numpy as np
from pyspark.sql import functions as F
from quaver.operators import counters


def columns(spark, n, seeds, first=0):
    rows = spark.range(first, first + n).select(*[counters.draw(F.col("id"), s).alias(f"s{i}") for i, s in enumerate(seeds)])
    return np.array(rows.collect()).T


def plain(counter, seed, stream=0):
    x, y = counter & counters.MASK, counter >> 32 & counters.MASK
    for key in counters.round_keys(seed, stream):
        p = x * counters.MULTIPLIER
        x, y = p >> 32 ^ key ^ y, p & counters.MASK
    return (x << 21) + (y >> 11)


def test_draws_equal_a_plain_model_for_any_counter(spark):
    ids = [0, 1, -1, 2**31, 2**32, 2**63 - 1, -(2**63), 12345678901234567, None]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", counters.draw(F.col("id"), 9, 2).alias("d")).collect()
    assert {r["id"]: r["d"] for r in rows} == {i: None if i is None else plain(i % (1 << 64), 9, 2) for i in ids}


def test_seeds_are_independent_and_not_shifted(spark):
    seeds = (0, 1, 2, 3, 42, -1, 2**40)
    d = columns(spark, 20_000, seeds)
    for i in range(len(seeds)):
        assert len(np.unique(d[i])) == 20_000
        assert abs(d[i].mean() / counters.RANGE - 0.5) < 0.01
        assert np.histogram(d[i], 20, (0, counters.RANGE))[0].std() < 60
        assert abs(np.corrcoef(d[i][:-1], d[i][1:])[0, 1]) < 0.03
        for j in range(i):
            # No value of one seed is another's, at whatever distance of ids, and they do not go together.
            assert not np.intersect1d(d[i], d[j]).size
            assert abs(np.corrcoef(d[i], d[j])[0, 1]) < 0.03


def test_ids_far_apart_draw_apart(spark):
    near, far = columns(spark, 5000, (1,)), columns(spark, 5000, (1,), 1 << 31)
    assert not (near == far).any() and abs(np.corrcoef(near[0], far[0])[0, 1]) < 0.05


def test_normals_coins_and_whole_numbers(spark):
    rows = spark.range(20_000).select(counters.normal(F.col("id"), 5).alias("n"), counters.coin(F.col("id"), 5, 0.3).alias("c"), counters.whole(F.col("id"), 6, 7).alias("w"))
    r = rows.agg(F.avg("n"), F.stddev("n"), F.skewness("n"), F.kurtosis("n"), F.avg(F.col("c").cast("int")), F.min("w"), F.max("w")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.02 and abs(r[2]) < 0.06 and abs(r[3]) < 0.12 and abs(r[4] - 0.3) < 0.02 and (r[5], r[6]) == (0, 6)
