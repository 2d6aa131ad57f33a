"""Ranked lexical search with block-max pruning over a forward index.

``write_index`` cuts the documents of each task into ranges of ``BLOCK`` documents and
stores, for the terms of a query set, a forward index (per document its terms and
their counts) and per range and term the greatest count and the least document
length. ``search`` bounds each range for a query by its maxima, takes the ranges
of a chunk from the greatest bound down and scores their documents from the forward
index until a bound is below the query's threshold: the score that the k-th best
document is known to reach. A first round scores one range a query and chunk; the
thresholds that all tasks reach together prune the second, complete round.

Queries come in groups of ``group_bytes`` of text, and each group is one index and two
rounds; a task holds a group's vocabulary, one chunk of the index and k results a query,
and sends k results a query. Weights and scores are whole numbers of 64 bits.

Defined results: a null text has no terms. A document without id counts in the
statistics and is never a result; rows that repeat an id are documents of their own.
Equal item rows are one; different texts of one item id are one item with the terms of
all. An item without terms, or without matches, has no rows; neither has an empty
table. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaver.llm.common import arrow_rows, new_path, read, stored

#: Over UTF-8: every byte of a character beyond ASCII belongs to a term.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents a range, and what closes a chunk of ranges, a row of the index.
BLOCK, CHUNK_DOCS, CHUNK_ENTRIES = 32, 2048, 1 << 18
GROUP_BYTES = 4 << 20
FIELDS = ("doc_ids", "sizes", "starts", "terms", "counts", "max_starts", "max_terms", "max_counts", "min_sizes", "df_terms", "dfs")
INDEX = "n_docs long, n_terms long, " + ", ".join(f"{f} array<{'long' if f == 'doc_ids' else 'int'}>" for f in FIELDS)


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def chunk(docs: list[tuple[int, int, list[int]]]) -> dict[str, np.ndarray]:
    """Forward index and maxima of ``(id, length, numbers of the known terms)`` documents, each with a known term at least."""
    pairs = [np.unique(np.array(t, np.int32), return_counts=True) for _, _, t in docs]
    terms, counts = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]).astype(np.int32)
    lengths = np.array([len(p[0]) for p in pairs])
    sizes = np.array([n for _, n, _ in docs], np.int32)
    block = np.repeat(np.arange(len(docs)) // BLOCK, lengths)
    order = np.lexsort((terms, block))
    first = np.flatnonzero(np.diff(block[order], prepend=-1) | np.diff(terms[order], prepend=-1))
    return {
        "doc_ids": np.array([d for d, _, _ in docs], np.int64),
        "sizes": sizes,
        "starts": np.concatenate([[0], np.cumsum(lengths)]),
        "terms": terms,
        "counts": counts,
        "max_starts": np.searchsorted(block[order][first], np.arange(block[-1] + 2)),
        "max_terms": terms[order][first],
        "max_counts": np.maximum.reduceat(counts[order], first),
        "min_sizes": np.minimum.reduceat(np.repeat(sizes, lengths)[order], first),
    }


def write_index(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """The stored index of ``docs`` (``doc_id``, a text) for a vocabulary."""
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *[(f, pa.list_(pa.int64() if f == "doc_ids" else pa.int32())) for f in FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nameless, entries, n_docs, n_terms = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, nameless, entries, n_docs, n_terms
            # A chunk whose documents have no known term, or no id, still has its counts.
            parts = chunk(held) if held else {f: np.zeros(0, np.int64) for f in FIELDS}
            parts["df_terms"], parts["dfs"] = np.unique(np.concatenate([parts["terms"], *nameless]), return_counts=True)
            values = [[n_docs], [n_terms], *[[parts[f]] for f in FIELDS]]
            held, nameless, entries, n_docs, n_terms = [], [], 0, 0, 0
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, schema.types)], schema=schema)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(body.as_py() or b"")
                n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                known = [t for t in map(vocabulary.get, words) if t is not None]
                if known and doc_id is None:
                    nameless.append(np.unique(np.array(known, np.int32)))
                elif known:
                    held.append((doc_id, len(words), known))
                entries += len(known)
                if len(held) >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                    yield close()
        if n_docs:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("text is not null")
    with arrow_rows(docs.sparkSession, 1000):
        return stored(rows.mapInArrow(run, INDEX), "lexical-index")


class Scorer:
    """The queries of a group over chunks of an index; keeps the k best documents of each."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int, floors: np.ndarray | None = None):
        self.queries, self.weights, self.n, self.total, self.k = queries, weights, n, total, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]
        self.floors = np.ones(len(queries), np.int64) if floors is None else floors.copy()
        #: A query's weights by term; set and cleared a query at a time.
        self.dense = np.zeros(len(weights), np.int64)
        self.scored = self.seen = 0

    def impact(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rises with the count and falls with the length, so that a range's maxima bound it."""
        counts = counts.astype(np.int64)
        m = 100 - 25 + 25 * sizes.astype(np.int64) * self.n // self.total
        return 1_000_000_000 * counts // (1000 * counts + 12 * m)

    def bounds(self, query: int, starts: np.ndarray, terms: np.ndarray, block: np.ndarray, values: np.ndarray) -> np.ndarray:
        """A bound for each range, from maxima in order of their terms."""
        wanted, repeats = self.queries[query]
        low, high = np.searchsorted(terms, wanted), np.searchsorted(terms, wanted, "right")
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros(len(starts) - 1, np.int64)
        np.add.at(out, block[at], values[at] * np.repeat(repeats * self.weights[wanted], sizes))
        return out

    def add(self, part: dict[str, np.ndarray], most: int | None = None) -> None:
        """Score a chunk; ``most``: so many ranges a query at most."""
        starts, terms, doc_ids = part["starts"], part["terms"], part["doc_ids"]
        impact = self.impact(part["counts"], np.repeat(part["sizes"], np.diff(starts)))
        block = np.repeat(np.arange(len(part["max_starts"]) - 1), np.diff(part["max_starts"]))
        order = np.argsort(part["max_terms"], kind="stable")
        maxima = part["max_starts"], part["max_terms"][order], block[order], self.impact(part["max_counts"], part["min_sizes"])[order]
        for q, (wanted, repeats) in enumerate(self.queries):
            bounds = self.bounds(q, *maxima)
            ranges = np.argsort(-bounds, kind="stable")
            self.seen += len(ranges)
            self.dense[wanted] = repeats * self.weights[wanted]
            for b in ranges[:most]:
                if bounds[b] < self.floors[q]:
                    break
                self.scored += 1
                first, last = b * BLOCK, min((b + 1) * BLOCK, len(doc_ids))
                low, high = starts[first], starts[last]
                scores = np.add.reduceat(self.dense[terms[low:high]] * impact[low:high], starts[first:last] - low)
                self.offer(q, doc_ids[first:last], scores)
            self.dense[wanted] = 0

    def offer(self, q: int, doc_ids: np.ndarray, scores: np.ndarray) -> None:
        best = self.best[q]
        for i in np.flatnonzero(scores >= self.floors[q]):
            found = int(scores[i]), -int(doc_ids[i])
            if len(best) < self.k:
                heapq.heappush(best, found)
            else:
                heapq.heappushpop(best, found)
            if len(best) == self.k:
                self.floors[q] = max(self.floors[q], best[0][0])


def best_k(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _round(index: DataFrame, make, most: int | None) -> DataFrame:
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for batch in batches:
            for i in range(batch.num_rows):
                scorer.add({f: batch.column(f)[i].values.to_numpy(zero_copy_only=False) for f in FIELDS}, most)
        rows = [(q, -d, s) for q, best in enumerate(scorer.best) for s, d in best]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), schema.types)], schema=schema)

    return index.select(*FIELDS).where("size(doc_ids) > 0").mapInArrow(run, "query int, doc_id long, score long")


def _search_group(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int, text: str) -> DataFrame:
    spark = docs.sparkSession
    bags = [(item_id, Counter(terms_of(body))) for item_id, body in items]
    bags = [(item_id, bag) for item_id, bag in bags if bag]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, bag in bags for t in bag}))}
    queries = []
    for _, bag in bags:
        pairs = sorted((vocabulary[t], c) for t, c in bag.items())
        queries.append((np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))
    index = write_index(docs, vocabulary, text)
    n, total = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    # Counts of the group's terms alone come to the driver.
    weights = np.full(len(vocabulary), math.floor(1000 * math.log(2 * n + 2)), np.int64)
    pairs = F.arrays_zip(F.col("df_terms").alias("t"), F.col("dfs").alias("n"))
    for r in index.select(F.inline(pairs)).groupBy("t").agg(F.sum("n").alias("n")).collect():
        weights[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["n"] + 1)))
    with arrow_rows(spark, 8):
        # An index row is some megabytes; the results are k rows a query.
        seeds = best_k(_round(index, lambda: Scorer(queries, weights, n, total, k), 1), k)
        reached = seeds.where(F.col("rank") == k).select("query", "score").collect()
        floors = np.ones(len(queries), np.int64)
        for r in reached:
            floors[r["query"]] = r["score"]
        found = stored(best_k(_round(index, lambda: Scorer(queries, weights, n, total, k, floors), None), k), "lexical-found")
    names = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(bags)], "query int, item_id long")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def groups(items: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in groups of some bytes of text; the driver holds one group at a time."""
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    rows = rows.groupBy("item_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        body = b"\n".join(map(bytes, r["texts"]))
        if held and size + len(body) > group_bytes:
            yield held
            held, size = [], 0
        held.append((r["item_id"], body))
        size += len(body)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item by score above 0, ties to the smaller id."""
    spark: SparkSession = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in groups(items, group_bytes):
        if any(terms_of(body) for _, body in group):
            out = out.unionByName(_search_group(docs, group, k, text))
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH lower_d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM lower_d WHERE len(terms) > 0),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL),
t AS (
  SELECT r, doc_id, len(terms) AS n_doc, term, count(*) AS tf
  FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM lower_d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n_doc, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term, n),
s AS (
  SELECT item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n_doc * n) // l)))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), g WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
