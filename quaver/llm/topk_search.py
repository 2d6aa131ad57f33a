"""Exact top-k search by inner product with no-random-access aggregation.

A vector is a place in as many sorted lists as it has components. For a query each
list is read in order of what it adds to the score, so from the greatest value
down where the query's component is above zero and from the least up where it is
below. After reading a list to some depth, a vector that the list has not yielded
adds at most the value read last, and at least the list's other end; the sums over
lists are a vector's upper and lower score bound. A vector whose upper bound is below the
k-th greatest lower bound cannot qualify. Reading goes on, each step half of what is
unread, until at most ``RESOLVE`` vectors can still qualify or the lists are at their
ends; then the scores of those that stay are resolved.

Vectors are dealt to tiles of about ``TILE`` rows by a hash of the whole row, queries to
tiles likewise; each pair of tiles is one group of a cogroup, so a task holds two
tiles, whatever the table's size, and sends k rows a query and tile. The tables meet tile
by tile, never row by row. Within a pair, one matrix product a step bounds all queries
and vectors that are left: with the values not yet read set to the value read last,
the product of query and list values is the upper bound.

Defined results: null vectors and those with null or non-finite components take no
part, nor do rows without id. Rows equal in id and vector are one. Where an id has several
vectors, the least (in the order of arrays) is its query, and none of them is a candidate
of it. Vectors of different lengths never meet. Fewer candidates than k are all
returned. Components beyond what 64 bits hold are an error. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import read

#: Rows and components that a tile has at most, about; queries that are bounded at once.
TILE, TILE_VALUES, SLICE = 8192, 1 << 22, 1024
#: So many vectors are resolved without reading on.
RESOLVE = 64
RESULT = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """No component is null or beyond all finite values."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


class Lists:
    """The sorted lists of a tile, one a component, read from both ends."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.sorted = vectors, np.sort(vectors, axis=0)

    def read_last(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The values that a depth ends at, from above and from below."""
        return self.sorted[len(self.vectors) - depth], self.sorted[depth - 1]

    def upper(self, depth: int) -> np.ndarray:
        """What each vector adds at most, from above and from below: unread values are no further than the one read last."""
        above, below = self.read_last(depth)
        return np.hstack([np.maximum(self.vectors, above), np.minimum(self.vectors, below)])

    def lower(self, depth: int) -> np.ndarray:
        """What each vector adds at least: unread values may be the list's other end."""
        above, below = self.read_last(depth)
        return np.hstack([np.where(self.vectors >= above, self.vectors, self.sorted[0]), np.where(self.vectors <= below, self.vectors, self.sorted[-1])])


def _product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole-number products; in floating point where it holds every partial sum exactly."""
    size = lambda a: max(-int(a.min(initial=0)), int(a.max(initial=0)))
    most = size(queries) * size(vectors) * queries.shape[1]
    if most >= 1 << 63:
        raise OverflowError("a score may leave 64 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return queries.astype(kind) @ vectors.T.astype(kind)


def depths(n: int) -> Iterator[int]:
    """Half of the list, then half of what is left, to the end."""
    unread = n
    while unread:
        unread //= 2
        yield n - unread


def aggregate(lists: Lists, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, resolve: int = RESOLVE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query's number, ids, scores)``: the k best vectors of each query, by bounds of what the lists have yielded."""
    place, open_ = max(0, len(ids) - k), np.arange(len(queries))
    sides = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    for depth in depths(len(ids)):
        upper, lower = _product(sides[open_], lists.upper(depth)), _product(sides[open_], lists.lower(depth))
        own = query_ids[open_, None] == ids[None, :]
        lower[own] = np.iinfo(np.int64).min if lower.dtype == np.int64 else -np.inf
        kth = np.partition(lower, place, axis=1)[:, place]
        left = (upper >= kth[:, None]) & ~own
        settled = (left.sum(axis=1) <= resolve) | (depth == len(ids))
        for row in np.flatnonzero(settled):
            stay = np.flatnonzero(left[row])
            scores = _product(queries[open_[row]][None, :], lists.vectors[stay])[0].astype(np.int64)
            best = np.lexsort((ids[stay], -scores))[:k]
            yield int(open_[row]), ids[stay][best], scores[best]
        open_ = open_[~settled]
        if not len(open_):
            return


def best_k(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k vectors of the greatest inner product with each query's, itself left out."""
    rows = vectors.where(F.col(id_).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(id_).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("is_query")).withColumn("d", F.size("v"))
    n, widest = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    tile = max(1, min(tile, TILE_VALUES // max(1, widest or 1)))
    tiles = max(1, -(-n // tile))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).cast("int")
    # One row of each id and vector.
    candidates = rows.groupBy("d", "vec_id", "v").agg(F.max("is_query").alias("is_query"))
    queries = candidates.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    query_tiles = max(1, -(-rows.where("is_query").count() // tile))
    left = candidates.select("d", "vec_id", "v", place.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("query_tile"))
    query_place = F.pmod(F.xxhash64("vec_id"), F.lit(query_tiles)).cast("int")
    right = queries.select("d", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), query_place.alias("query_tile"))

    def pair(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(held) and len(asked):
            lists, ids = Lists(np.stack(held["v"].to_numpy()).astype(np.int64)), held["vec_id"].to_numpy()
            for at in range(0, len(asked), SLICE):
                some = asked.iloc[at : at + SLICE]
                names = some["vec_id"].to_numpy()
                for q, found, scores in aggregate(lists, ids, np.stack(some["v"].to_numpy()).astype(np.int64), names, k):
                    out += [(names[q], i, s) for i, s in zip(found, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["d", "tile", "query_tile"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(pair, RESULT)
    return best_k(found, k)


def op13_exact_topk(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT query_id, vec_id, coalesce(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * v[i])), 0)::BIGINT AS score
  FROM q JOIN v ON vec_id <> query_id AND len(v) = len(q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
