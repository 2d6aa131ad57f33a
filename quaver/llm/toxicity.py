"""Toxicity by the nearest labelled examples in exact TF-IDF cosine.

Terms are words and the first four and six bytes of longer words; the vocabulary is
all terms of a bounded sample of labelled rows, compared by 64-bit hashes. A term
weighs (1 + log of its count in the text) times the log of how rare it is among all
documents, times its relevance in the sample: the square of log2(2 + toxic examples
with it for each clean one), at shares as if both classes were equal in number. No
term is left out for its relevance.

All examples are in an inverted index, in order of their number of terms. Postings are
cut into blocks of examples with the block's greatest weight on record. A query adds up
its rare terms over all examples, which gives a least value of the k-th cosine; the
block maxima bound what its common terms can add, and only blocks in which an
example may still reach that value are visited for them, so that the neighbours are exact.
Postings of common terms are long enough to be kept as whole rows of blocks.

Neighbours vote with weights that fall with distance. For the calibration the sample is
cut into folds: examples of a fold vote by an index of the others, with relevances of
the others, and a monotone fit of labels on votes, weighted to the share of each class
in all labelled rows, turns votes into scores. A text without neighbour scores as
one with clean neighbours alone.

``MAX_EXAMPLES`` of each class, in order of a hash of their id, and ``MAX_BYTES`` of their
texts bound the sample; a labelled id that several rows have gives one text. Near copies
of one class count as one example, so that their words count once.

Defined results: null and empty texts score as texts without neighbour. Rows without
an id are scored and never learnt from. Repeated labels of an id count as toxic if
one says so; null labels are ignored. Without toxic examples every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm import common
from quaver.llm.common import small_batches, stored
from quaver.llm.textarrays import ALPHANUMERIC, Words, text_slices

MAX_EXAMPLES, MAX_BYTES, NEIGHBOURS, BLOCK = 2000, 32 << 20, 15, 64
STEMS, FOLDS, PARTS = (4, 6), 4, 3
#: Terms of more examples than one in so many are common ones.
COMMON = 16
#: Marks and share of all long words that a copy has in common with its original.
COPY_MARKS, COPY_SHARE = 3, 0.5
THRESHOLD = 0.3
SCORED = "score double, predicted int, neighbours array<struct<doc_id:long,similarity:double,toxic:int>>, terms array<string>"


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a slice's terms, and sorted (document, place of its hash, count, a word with it)."""
    places, hashes = [np.arange(len(words.hash))], [words.hash]
    for n in STEMS:
        at, h = words.prefixes(n)
        places.append(at)
        hashes.append(h)
    place = np.concatenate(places)
    distinct, local = np.unique(np.concatenate(hashes), return_inverse=True)
    pair, first, count = np.unique(words.doc[place] * max(1, len(distinct)) + local, return_index=True, return_counts=True)
    return distinct, pair // max(1, len(distinct)), pair % max(1, len(distinct)), count, place[first]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def vectors(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted (document, term, count, a word with it) of a slice."""
        distinct, doc, local, count, place = _counted(words)
        term = np.searchsorted(self.hashes, distinct)
        term[term == len(self.hashes)] = 0
        known = self.hashes[term] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        keep = known[local]
        return doc[keep], term[local[keep]], count[keep], place[keep]


@dataclass
class Examples:
    """Term counts of examples: those of example i stand from ``cut[i]`` to ``cut[i + 1]``."""

    doc_ids: np.ndarray
    toxic: np.ndarray
    cut: np.ndarray
    term: np.ndarray
    count: np.ndarray
    #: What an example of each class stands for.
    share: tuple[float, float]

    def part(self, rows: np.ndarray) -> Examples:
        size = (self.cut[1:] - self.cut[:-1])[rows]
        at = ranges(self.cut[rows], size)
        return Examples(self.doc_ids[rows], self.toxic[rows], np.concatenate([[0], np.cumsum(size)]), self.term[at], self.count[at], self.share)

    def row(self, i: int) -> slice:
        return slice(self.cut[i], self.cut[i + 1])


class Index:
    """Block-max inverted index over examples."""

    def __init__(self, examples: Examples, idf: np.ndarray):
        toxic = examples.toxic.astype(bool)
        row = np.repeat(np.arange(len(toxic)), np.diff(examples.cut))
        with_term = [np.bincount(examples.term[toxic[row] == k], minlength=len(idf)) for k in (False, True)]
        even = (~toxic).sum() / max(1, toxic.sum())
        self.base = idf * np.log2(2 + with_term[1] * even / np.maximum(1, with_term[0])) ** 2
        # Examples of like length have like weights, which keeps the blocks' bounds low.
        at = examples.part(np.lexsort((examples.doc_ids, np.diff(examples.cut))))
        self.doc_ids, self.toxic, self.blocks = at.doc_ids, at.toxic, -(-len(at.toxic) // BLOCK)
        row = np.repeat(np.arange(len(at.toxic)), np.diff(at.cut))
        weight = (1 + np.log(at.count)) * self.base[at.term]
        length = np.sqrt(np.bincount(row, weight * weight, len(at.toxic)))
        weight = np.divide(weight, length[row], out=np.zeros_like(weight), where=length[row] > 0)
        order = np.lexsort((row, at.term))
        term, self.example, self.weights = at.term[order], row[order].astype(np.int32), weight[order].astype(np.float32)
        start = np.searchsorted(term, np.arange(len(idf) + 1))
        common = np.flatnonzero(np.diff(start) * COMMON > len(at.toxic))
        #: By term: its row among the common ones or -1, or where its postings stand.
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.blocks, BLOCK), np.float32)
        own = np.flatnonzero(self.row[term] >= 0)
        self.rows[self.row[term[own]], self.example[own] // BLOCK, self.example[own] % BLOCK] = self.weights[own]
        self.block_max = self.rows.max(axis=2, initial=0)
        rare = np.flatnonzero(self.row[term] < 0)
        self.example, self.weights = self.example[rare], self.weights[rare]
        self.start = np.searchsorted(term[rare], np.arange(len(idf) + 1)).astype(np.int32)

    def weight(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.base[term]
        length = np.sqrt((w * w).sum())
        return w / length if length > 0 else w

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (over 0), ties by place, and the cosines."""

        row = self.row[term]
        start = self.start[term]
        size = self.start[term + 1] - start
        postings = ranges(start, size)
        scores = np.zeros((self.blocks, BLOCK))
        scores.ravel()[:] = np.bincount(self.example[postings], np.repeat(weight, size) * self.weights[postings], scores.size)
        least = np.partition(scores, -k, axis=None)[-k] if scores.size > k else 0.0
        row, weight = row[row >= 0], weight[row >= 0].astype(np.float32)
        visit = np.flatnonzero(scores.max(axis=1, initial=0) + weight @ self.block_max[row] >= least - 1e-6)
        whole = self.rows[row] if len(visit) == self.blocks else self.rows[row[:, None], visit]
        scores[visit] += np.tensordot(weight, whole, 1)
        scores = scores.ravel()
        found = np.flatnonzero(scores > 0)
        if len(found) > 4 * k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k] - 1e-9]
        best = found[np.lexsort((found, -np.round(scores[found], 12)))[:k]]
        return best, scores[best]

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        w = 1 / (0.1 + 1 - np.minimum(cosines, 1))
        return float((w * self.toxic[best]).sum() / w.sum())


@dataclass
class Model:
    vocabulary: Vocabulary
    index: Index
    calibration: tuple[np.ndarray, np.ndarray]

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.calibration))


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic fit of y on x by pooling neighbours out of order; knots for interpolation.

    Equal x are one point before any pooling: else their first y can tie them to all that lies before.
    """
    points, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for a, s, c in zip(points, np.bincount(at, y * w), np.bincount(at, w)):
        pools.append([s, c, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, t, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += t
            pools[-1][3] = hi
    ends = [(at, p[0] / p[1]) for p in pools for at in dict.fromkeys((p[2], p[3]))]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def training_rows(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the labelled rows that may be learnt from."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 4 == 2


def _copies(hashes: list[np.ndarray], marks: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Rows that share ``COPY_MARKS`` marks, ``COPY_SHARE`` of both rows' words and the label with one and the same earlier row that stays."""
    drop = np.zeros(len(hashes), bool)
    kept: dict[tuple[int, int], list[int]] = {}
    for i, (own, row) in enumerate(zip(hashes, marks)):
        if not len(own):
            continue
        lists = [kept.setdefault((k, int(m)), []) for k, m in enumerate(row)]
        earlier, shared = np.unique(np.array([j for x in lists for j in x], np.int64), return_counts=True)
        for j in earlier[shared >= COPY_MARKS]:
            both = len(np.intersect1d(own, hashes[j], assume_unique=True))
            if labels[i] == labels[j] and both >= COPY_SHARE * (len(own) + len(hashes[j]) - both):
                drop[i] = True
                break
        if not drop[i]:
            for x in lists:
                x.append(i)
    return drop


def _without_copies(sample: DataFrame) -> DataFrame:
    """One example of each group of copies, so that their words count once.

    Eight hash functions each mark a text by the least hash of its long words.
    Rows with three marks of an earlier row are compared with that row.
    """
    long = F.filter(common.words(F.col("text")), lambda w: F.octet_length(w) >= 9)
    hashes = F.array_distinct(F.transform(long, lambda w: F.xxhash64(w)))

    def least(k: int) -> Column:
        return F.array_min(F.transform(F.col("hashes"), lambda h: F.xxhash64(h, F.lit(k))))

    sample = stored(sample.select("*", F.monotonically_increasing_id().alias("_row")), "toxic-sample")
    each = sample.select("_row", "doc_id", "toxic", hashes.alias("hashes")).select("*", F.array(*[least(k) for k in range(8)]).alias("marks"))
    # At most twice MAX_EXAMPLES rows, and repeats of their ids.
    rows = each.where(F.size("hashes") > 0).toPandas().sort_values(["doc_id", "_row"])
    drop = _copies(list(rows["hashes"]), list(rows["marks"]), list(rows["toxic"]))
    copies = sample.sparkSession.createDataFrame([(int(r),) for r in rows["_row"][drop]], "_row long")
    return stored(sample.join(F.broadcast(copies), "_row", "left_anti").select("doc_id", "toxic", "text"), "toxic-sample")


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents with each term, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary.hashes), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, offsets, data in text_slices(batch.column(0)):
                total += np.bincount(vocabulary.vectors(Words(offsets, data, ALPHANUMERIC))[1], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(full, -1).astype(np.int32)), pa.array(np.append(total[full], n))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, count = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    out = np.zeros(len(vocabulary.hashes), np.int64)
    out[term[term >= 0]] = count[term >= 0]
    return out, int(count[term < 0].sum())


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, toxic, text`` of the examples, and the labelled rows of each class."""
    rows = training_rows(labels)
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pick = None
    for label in (0, 1):
        own = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
        pick = own if pick is None else pick.union(own)
    # At most MAX_EXAMPLES ids of each class.
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in pick.collect()], "doc_id long, toxic int")
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text")).join(F.broadcast(ids), "doc_id")
    texts = stored(texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic-sample")
    sizes = texts.select("doc_id", "toxic", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).toPandas()
    sizes = sizes.sort_values(["toxic", "h", "doc_id"])
    kept = sizes[sizes.groupby("toxic")["n"].cumsum() <= MAX_BYTES]
    ids = docs.sparkSession.createDataFrame([(int(x),) for x in kept["doc_id"]], "doc_id long")
    return _without_copies(texts.join(F.broadcast(ids), "doc_id", "left_semi")), counts


def _examples(sample: DataFrame, counts: dict[int, int]) -> tuple[Vocabulary, Examples]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in text_slices(batch.column(2)):
                distinct, doc, local, count, _ = _counted(Words(offsets, data, ALPHANUMERIC))
                size = np.bincount(doc, minlength=len(offsets) - 1)
                part = batch.slice(first, len(offsets) - 1)
                ids, toxic = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                row = [x.astype(t).tobytes() for x, t in ((ids, "<i8"), (toxic, "<i8"), (size, "<i8"), (distinct[local], "<u8"), (count, "<i4"))]
                yield pa.record_batch([pa.array([x], pa.binary()) for x in row], names=["ids", "toxic", "size", "terms", "counts"])

    # A bounded sample: its term counts go to the driver, which broadcasts the index.
    packed = sample.select("doc_id", "toxic", "text").mapInArrow(run, "ids binary, toxic binary, size binary, terms binary, counts binary").collect()
    ids, toxic, size, term, count = (
        np.concatenate([np.zeros(0, t), *[np.frombuffer(r[k], t) for r in packed]]) for k, t in enumerate(("<i8", "<i8", "<i8", "<u8", "<i4"))
    )
    hashes, term = np.unique(term, return_inverse=True)
    seen = [int((toxic == k).sum()) for k in (0, 1)]
    share = tuple(counts.get(k, 0) / max(1, seen[k]) for k in (0, 1))
    at = Examples(ids, toxic, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), term.astype(np.int32), count, share)
    return Vocabulary(hashes), at.part(np.argsort(ids, kind="stable"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    sample, counts = _sample(docs, labels)
    vocabulary, examples = _examples(sample, counts)
    frequency, n = _frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + frequency))
    calibration = (np.zeros(1), np.zeros(1))
    if examples.toxic.any():
        votes = _fold_votes(spark, examples, idf)
        if len(votes):
            weights = np.array(examples.share)[votes["toxic"].to_numpy(np.int64)]
            calibration = monotone(votes["vote"].to_numpy(), votes["toxic"].to_numpy(np.float64), weights)
    return Model(vocabulary, Index(examples, idf), calibration)


def _fold_votes(spark, examples: Examples, idf: np.ndarray) -> pd.DataFrame:
    """``vote, toxic`` of the examples that have a neighbour among those of the other folds."""
    shared = spark.sparkContext.broadcast((examples, idf))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples, idf = shared.value
        fold = np.arange(len(examples.toxic)) % FOLDS
        for frame in frames:
            for turn in frame["id"]:
                own, part = turn % FOLDS, turn // FOLDS
                index = Index(examples.part(np.flatnonzero(fold != own)), idf)
                votes = []
                for i in np.flatnonzero(fold == own)[part::PARTS]:
                    at = examples.row(i)
                    best, cosines = index.nearest(examples.term[at], index.weight(examples.term[at], examples.count[at]))
                    if len(best):
                        votes.append((index.vote(best, cosines), int(examples.toxic[i])))
                yield pd.DataFrame(votes, columns=["vote", "toxic"]).astype({"vote": float, "toxic": "int32"})

    turns = spark.range(0, FOLDS * PARTS, 1, FOLDS * PARTS)
    votes = turns.mapInPandas(run, "vote double, toxic int").toPandas().sort_values(["vote", "toxic"])
    shared.unpersist()
    return votes


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the columns of ``SCORED``; the model has a bounded number of examples and bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A text that is kept goes to Python once.
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("_scored_text"))
    text_at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = model.index
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            for first, offsets, data in text_slices(batch.column(text_at)):
                words = Words(offsets, data, ALPHANUMERIC)
                doc, term, count, place = model.vocabulary.vectors(words)
                cut = np.searchsorted(doc, np.arange(len(offsets)))
                scores, near, why = [], [], []
                for a, b in zip(cut[:-1], cut[1:]):
                    weight = index.weight(term[a:b], count[a:b])
                    best, cosines = index.nearest(term[a:b], weight) if b > a else ((), ())
                    scores.append(model.calibrated(index.vote(best, cosines) if len(best) else 0.0))
                    near.append([{"doc_id": int(index.doc_ids[i]), "similarity": float(c), "toxic": int(index.toxic[i])} for i, c in zip(best[:3], cosines[:3])])
                    top = place[a:b][np.argsort(-weight, kind="stable")[:3]]
                    why.append(list(dict.fromkeys(words.text(i, i + 1).decode("utf-8", "replace") for i in top)))
                part = batch.slice(first, len(offsets) - 1)
                arrays = [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(near, kind), pa.array(why, pa.list_(pa.string()))]
                yield pa.record_batch([*part.columns[: len(keep)], *arrays], names=[*keep, "score", "predicted", "neighbours", "terms"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    return rows.mapInArrow(run, ", ".join([*fields, SCORED]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours", "terms")
