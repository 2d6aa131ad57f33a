import math

import numpy as np
from pyspark.sql import functions as F
from quaver.llm import topk_search


def plain(rows, k):
    ok = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in {i for i, _ in ok if i % 50 == 0}:
        own = min(v for i, v in ok if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in ok if i != q and len(v) == len(own))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, query_id string, score int")


def fixture():
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(0, 0.2, 12)).tolist()) for i in range(700)]
    copy = rows[10][1]
    rows += [(1000 + i, copy) for i in range(150)] + [(i, [0.0] * 12) for i in range(2000, 2030)]
    rows += [(3, rows[3][1]), (50, copy), (150, [None] + [0.1] * 11), (200, None), (None, copy), (250, [float("nan")] * 12), (251, [float("inf")] * 12)]
    return rows


def test_equal_to_all_inner_products(spark):
    rows = fixture()
    data = table(spark, rows)
    want = plain(rows, 5)
    for tile in (8192, 100):
        got = topk_search.search(data, F.col("vec_id") % 50 == 0, tile=tile)
        assert sorted(map(tuple, got.collect())) == want


def test_few_candidates_other_lengths_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (7, [3.0, 1.0, 1.0]), (100, [1.0, 0.0, 0.0]), (150, [])]
    got = topk_search.search(table(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5)
    assert topk_search.search(table(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_reading_stops_before_the_ends():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-20, 20, (4000, 8))
    vectors[:9] = 300 + np.arange(9)[:, None]
    lists, read = topk_search.Lists(vectors), []
    lists.read_last, last = lambda depth: (read.append(depth), last(depth))[1], lists.read_last
    found = list(topk_search.aggregate(lists, np.arange(4000), np.ones((1, 8), np.int64), np.array([-1]), 5))
    assert found[0][1].tolist() == [8, 7, 6, 5, 4] and max(read) < 4000
    huge = np.full((3, 2), 1 << 40)
    assert [f[2].tolist() for f in topk_search.aggregate(topk_search.Lists(huge), np.arange(3), np.array([[1 << 20, 5]]), np.array([9]), 2)] == [[(1 << 60) + 5 * (1 << 40)] * 2]
