import random

import numpy as np
from pyspark.sql import functions as F
from quaver.operators import budget, quantiles


def test_quantiles_of_hot_tied_and_odd_groups(spark):
    rng = np.random.default_rng(2)
    groups = {
        "hot": rng.normal(0, 1, 30_000), "tied": np.r_[np.full(20_000, 7.5), rng.normal(7.5, 1e-9, 50)], "one": np.array([3.0]), "two": np.array([1.0, 2.0]),
        "far": rng.choice([-1, 1], 9000) * 10.0 ** rng.integers(-300, 300, 9000), None: rng.integers(0, 5, 8000).astype(float), "same": np.full(9000, -0.25),
    }
    rows = [(k, float(v), "x") for k, vs in groups.items() for v in vs] + [("nulls", None, "x"), ("one", None, "x")]
    df = spark.createDataFrame(rows, "name string, x double, v string")
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    want = {(k, s): np.quantile(v, s) for k, v in groups.items() for s in shares}
    for few in (50, 4096):
        got = {(r["name"], r["q"]): r["v"] for r in quantiles.quantiles(df, ["name"], "x", shares, few).collect()}
        assert got.keys() == want.keys()
        assert all(np.isclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)
    whole = quantiles.quantiles(df, [], "x", [0.5], 50).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["v"], np.median(np.concatenate(list(groups.values()))))
    assert quantiles.quantiles(df.limit(0), ["name"], "x", [0.5]).count() == 0


def test_a_quantile_round_reads_each_row_once_a_range(spark):
    # Ranks that share a range share its work, and a row meets two splitters: no array of them, no lambda.
    values = spark.range(20_000).selectExpr("struct(0 as _all) as g", "cast(id % 7919 as double) as v")
    ranks = spark.createDataFrame([(k, 0.0, 7918.0, 20_000) for k in (999, 1000, 9999, 10_000, 18_999, 19_000)], "k long, low double, high double, n long")
    ranks = ranks.selectExpr("struct(0 as _all) as g", "*")
    want = sorted(i % 7919 for i in range(20_000))
    assert {r["k"]: r["v"] for r in quantiles.order_statistics(values, ranks, 100).collect()} == {k: want[k] for k in (999, 1000, 9999, 10_000, 18_999, 19_000)}
    plan = quantiles._narrow(values, ranks.withColumn("rank", F.col("k")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.lower()


def fold(segments, duration, offset, minimum, slide, buffer):
    """The running duration, a segment at a time."""
    past, out = 0, []
    for seg_id, start, end in segments:
        length = end - start
        if past - offset >= duration or (minimum is not None and length - slide < minimum):
            continue
        if past + length < offset:
            past += length - slide
            continue
        if past < offset:
            start, past = start + offset - past, offset
            length = end - start
            if minimum is not None and length - slide < minimum:
                continue
        over = past + length - slide - (offset + duration)
        if over > 0:
            end += buffer - over
        out.append((seg_id, start, end))
        past += end - start - slide
    return out


def left_over(segments, tested, offset, minimum, slide, buffer):
    out, kept = [], {(s, e) for _, s, e in tested}
    for seg_id, start, end in fold(segments, 10**12, offset, minimum, slide, buffer):
        if (start, end) in kept:
            continue
        if tested and start == tested[-1][1]:
            if end - tested[-1][2] <= buffer:
                continue
            start = tested[-1][2] + buffer
        out.append((seg_id, start, end))
    return out


def test_budget_equals_the_fold_in_both_modes(spark):
    rng = random.Random(8)
    cases = [(1000, 0, None, 0), (1000, 700, 60, 20), (400, 150, 10, 5), (10**7, 300, None, 3), (100, 10**7, 30, 0), (250, 0, 200, 10), (777, 333, 45, 44), (1, 5, None, 0)]
    for duration, offset, minimum, slide in cases:
        at, segments = 0, []
        for i in range(60):
            at += rng.randint(1, 30)
            segments.append((i, at, at + rng.randint(20, 200)))
            at = segments[-1][2]
        df = spark.createDataFrame(rng.sample([(*s, "more") for s in segments], 60), "seg_id long, start long, end long, other string")
        want = fold(segments, duration, offset, minimum, slide, 8)
        tested = budget.testing(df, duration, offset, minimum, slide, 8)
        assert sorted(map(tuple, tested.collect())) == want
        trained = budget.training(df, tested, offset, minimum, slide, 8)
        assert sorted(map(tuple, trained.collect())) == left_over(segments, want, offset, minimum, slide, 8)
    none = df.limit(0)
    assert budget.testing(none, 10).count() == 0 and budget.training(none, none, 10).count() == 0
    assert budget.testing(df.select("seg_id", F.lit(None).cast("long").alias("start"), "end"), 10).count() == 0
