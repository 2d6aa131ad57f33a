"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

A window is ``size`` consecutive words of a benchmark item, or a whole shorter
item. Its words are ordered by how rare they are in all documents; as a document
must hold every word of a window, the rarest one is the necessary prefix. A
word of a document that is some window's prefix proposes the one place where the
window could start (positional bound) if that place leaves room for it in the
document (length bound); what is proposed is compared word by word, and bytes
decide in the end.

The benchmark is the stated query set. While its text is within
``block_bytes`` its windows are broadcast; beyond that it is cut into blocks of
that size, each of which is held against all documents, and the blocks' hits are
merged by row.

Defined results: null and empty texts have no words, hit nothing, and as items
have no window. Repeated items count once by id; an item without an id counts
under the empty name. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import stored
from quaver.llm.textarrays import ALPHANUMERIC, Words, text_slices

SIZE = 13
SCANNED = "doc_id long, row long, n_words long, hits array<long>, items array<string>"
FOUND = "doc_id long, row long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"


class Windows:
    """The windows of a block of items, to be looked up by their rarest word."""

    def __init__(self, items: list[tuple[str, str]], size: int = SIZE):
        self.size = size
        column = pa.array([text for _, text in items], pa.string())
        hashes, spans, names, texts = [], [], [], []
        base = 0
        for first, offsets, data in text_slices(column, 1 << 30):
            words = Words(offsets, data, ALPHANUMERIC)
            hashes.append(words.hash)
            for d in range(len(offsets) - 1):
                a, b = int(words.first[d]), int(words.first[d + 1])
                length = min(size, b - a)
                for s in range(a, b - length + 1) if length else ():
                    spans.append((base + s, length))
                    names.append(items[first + d][0])
                    texts.append(words.text(s, s + length))
            base += len(words.hash)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start, self.length = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        self.name, self.text = names, texts

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.hash)

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's rarest word; ``counts`` go with ``vocabulary()``."""
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        of_word = rank[np.searchsorted(self.vocabulary(), self.hash)]
        self.offset = np.array([int(np.argmin(of_word[s : s + n])) for s, n in zip(self.start, self.length)], np.int64)
        prefix = self.hash[self.start + self.offset] if len(self.start) else np.zeros(0, np.uint64)
        by = np.argsort(prefix, kind="stable")
        self.by, self.keys = by, prefix[by]
        self.unique, self.at, self.many = np.unique(self.keys, return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.unique & np.uint64(0xFFFF)).astype(np.int64)] = True

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word at which it starts, window) of every occurrence."""
        maybe = np.flatnonzero(self.filter[(words.hash & np.uint64(0xFFFF)).astype(np.int64)])
        where = np.searchsorted(self.unique, words.hash[maybe])
        where[where == len(self.unique)] = 0
        sure = self.unique[where] == words.hash[maybe] if len(self.unique) else np.zeros(0, bool)
        places, where = maybe[sure], where[sure]
        many = self.many[where]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window = self.by[np.repeat(self.at[where], many) + nth]
        place = np.repeat(places, many)
        doc = words.doc[place]
        start = place - self.offset[window]
        fits = (start >= words.first[doc]) & (start + self.length[window] <= words.first[doc + 1])
        start, window = start[fits], window[fits]
        for k in range(self.size):
            inside = k < self.length[window]
            same = np.ones(len(start), bool)
            same[inside] = words.hash[start[inside] + k] == self.hash[self.start[window[inside]] + k]
            start, window = start[same], window[same]
        exact = [words.text(s, s + self.length[w]) == self.text[w] for s, w in zip(start, window)]
        return start[exact], window[exact]


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each hash of a (bounded) vocabulary occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        known = np.zeros(1 << 16, bool)
        known[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for _, offsets, data in text_slices(batch.column(0)):
                hashes = Words(offsets, data, ALPHANUMERIC).hash
                hashes = hashes[known[(hashes & np.uint64(0xFFFF)).astype(np.int64)]]
                at = np.searchsorted(vocabulary, hashes)
                at[at == len(vocabulary)] = 0
                total += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for word, n in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
            out[word] = n
    return out


def _scan(docs: DataFrame, windows: Windows, only: bool) -> DataFrame:
    """Hits of a block's windows; the finished rows where it is the only block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in text_slices(batch.column(2)):
                words = Words(offsets, data, ALPHANUMERIC)
                start, window = windows.occurrences(words)
                n = len(offsets) - 1
                hits: list = [[] for _ in range(n)]
                items: list = [set() for _ in range(n)]
                for s, w in zip(start.tolist(), window.tolist()):
                    d = int(words.doc[s])
                    hits[d] += [s - int(words.first[d]), s - int(words.first[d]) + int(windows.length[w])]
                    items[d].add(windows.name[w])
                part = batch.slice(first, n)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(np.diff(words.first)), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["doc_id", "row", "n_words", "hits", "items"],
                )

    texts = docs.select("doc_id", "row", "text")
    # One Python function a task: two in a row would take two workers.
    return texts.mapInArrow(lambda batches: _covered(run(batches)), FOUND) if only else texts.mapInArrow(run, SCANNED)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, digest, n_items, sorted_names = [], [], [], []
        for hits, items in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            spans, reach, total = sorted(zip(hits[::2], hits[1::2])), 0, 0
            for a, b in spans:
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            n_hit.append(total)
            names = sorted(set(items))
            sorted_names.append(names)
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(sorted_names, pa.list_(pa.string()))],
            names=["doc_id", "row", "n_words", "n_hit", "n_items", "items_sha256", "items"],
        )


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` has ``doc_id``, ``row`` (unique) and ``text``; ``benchmark`` ``item_id`` and ``text``."""
    items = benchmark.where("text is not null and text <> ''").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    docs = stored(docs, "decontaminate") if blocks > 1 else docs
    scans = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        windows = Windows([tuple(r) for r in own.collect()], size)
        windows.order(word_counts(docs, windows.vocabulary()))
        scan = _scan(docs, windows, blocks == 1)
        scans = scan if scans is None else scans.union(scan)
    if blocks == 1:
        return scans
    scans = scans.groupBy("doc_id", "row", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return scans.mapInArrow(_covered, FOUND)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    found = find_contamination(rows.select("doc_id", F.col("_row").alias("row"), "text"), benchmark)
    bad = stored(found.where(contaminated()).select(F.col("row").alias("_row")), "contaminated")
    return rows.join(bad, "_row", "left_anti").select(docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS n
       FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row_no, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT row_no, p, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT row_no, count(DISTINCT q) AS n_hit FROM (SELECT row_no, unnest(range(p, p + n)) AS q FROM hit) GROUP BY row_no),
items AS (SELECT row_no, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS digest FROM hit GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
"""
