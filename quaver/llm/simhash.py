"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most four of 64 bits agree in at least four of
their eight bytes. Postings of single bytes would each hold a 256th of all
rows, so the index intersects them three positions at a time: its 20 triples
are chosen so that any four positions contain one. Under each posting the shared
positional bytes of a pair are tallied, pairs with four or more are kept, and a
bit count verifies them.

Equal fingerprints meet once, as one node. A posting with many fingerprints is
not expanded into its pairs: a search that spreads from one fingerprint to the
ones not yet reached finds its components and gives one edge a fingerprint. The
edges of all postings are joined into components by alternating large-star and
small-star steps, whose tables are written to the shared folder. Large postings are
split by a further byte, and rows of a key that very many share (a hub of a
component, one fingerprint of many texts) are joined where they are.

Defined results: a text without words has fingerprint zero and links like any
other. Null ids count as no id: a component's id is the smallest id in it, null
if it has none. Repeated rows are members of one component. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import partitions, stored

BITS, SEED, SHINGLE = 4, 42, 4
MATCHES = 8 - BITS
#: Fingerprints that a posting holds at most without being split, and the share of rows that makes a key heavy.
SPLIT, HEAVY = 4096, 1024


def _triples() -> list[tuple[int, int, int]]:
    """Triples of eight positions of which any four positions contain one.

    Three groups in a circle: a triple lies in one group, or two of it in a group
    and one in the next. Of four positions in three groups, one of these holds.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        g = sorted(group[i] for i in t)
        if len(set(g)) == 1 or any(g.count(k) == 2 and g.count((k + 1) % 3) == 1 for k in range(3)):
            out.append(t)
    return out


TRIPLES = _triples()


def fingerprint(text: bytes) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = SHINGLE - 1
    pairs = zip(starts.tolist(), ends[last:].tolist()) if len(words) >= SHINGLE else [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        out = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64)
        yield pa.record_batch([*batch.columns[:-1], pa.array(out.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``fp``, the fingerprint's bits as a long."""
    rows = docs.select(*keep, F.col(text).alias("_hashed_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_fingerprints, f"{fields}, fp long")


def linked(x: np.ndarray) -> np.ndarray:
    """Of XORs: enough equal bytes, then few enough different bits."""
    differs = x | (x >> np.uint64(4))
    differs |= differs >> np.uint64(2)
    differs |= differs >> np.uint64(1)
    tally = 8 - np.bitwise_count(differs & np.uint64(0x0101010101010101))
    return (tally >= MATCHES) & (np.bitwise_count(x) <= BITS)


def spanning_edges(fps: np.ndarray, tile: int = 128) -> list[tuple[int, int]]:
    """Edges that connect what the links between distinct ``fps`` connect.

    Frontier and rest meet in tiles, so that memory stays at a few MB.
    """
    out = []
    left = fps
    while len(left) > 1:
        seed, left = left[0], left[1:]
        frontier = np.array([seed])
        while len(frontier) and len(left):
            reached = np.zeros(len(left), bool)
            for k in range(0, len(frontier), tile):
                rest = np.flatnonzero(~reached)
                for j in range(0, len(rest), 16 * tile):
                    some = rest[j : j + 16 * tile]
                    reached[some] = linked(left[some][:, None] ^ frontier[None, k : k + tile]).any(axis=1)
            frontier, left = left[reached], left[~reached]
            out += [(int(seed), int(f)) for f in frontier]
    return out


def _posting_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a posting may go on in the next batch."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        # Postings of a few, by their size at once; larger ones each on its own.
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for size in range(2, 9):
            at = starts[sizes == size]
            for i, j in combinations(range(size), 2):
                x, y = fps[at + i], fps[at + j]
                ok = linked(x ^ y)
                a.append(x[ok])
                b.append(y[ok])
        for at, size in zip(starts[sizes > 8], sizes[sizes > 8]):
            if found := spanning_edges(fps[at : at + size]):
                pair = np.array(found, np.uint64)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        return pa.record_batch([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column(0).to_numpy()])
        fps = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        open_ = int(np.searchsorted(keys, keys[-1], "left"))
        held_key, held_fp = keys[open_:], fps[open_:]
        yield edges(keys[:open_], fps[:open_])
    yield edges(held_key, held_fp)


def link_edges(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``).

    A posting of more than ``split`` fingerprints is split: links in it agree in the posting's
    three bytes and in one of the other five at least, so they meet under that byte.
    """

    def byte(i: int) -> Column:
        return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))

    keys = [
        F.lit(k << 24).cast("long") + byte(x) * 65536 + byte(y) * 256 + byte(z) for k, (x, y, z) in enumerate(TRIPLES)
    ]
    posts = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    large = stored(posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split).select("key"), "postings")
    if not large.isEmpty():
        # No more keys than a split-th of all entries; Spark broadcasts them if they are few.
        posts = posts.join(large.withColumn("_large", F.lit(True)), "key", "left")
        others = F.array(*[F.array(*[F.lit(i) for i in range(8) if i not in t]) for t in TRIPLES])
        rest = F.get(others, F.shiftright("key", 24).cast("int"))
        finer = F.transform(rest, lambda i: F.xxhash64("key", i, _byte_at(i)))
        posts = posts.select(F.explode(F.when(F.col("_large"), finer).otherwise(F.array("key"))).alias("key"), "fp")
    dealt = posts.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_posting_edges, "a long, b long").distinct()


def _byte_at(i: Column) -> Column:
    """The i-th byte of ``fp``, by a column."""
    bytes_ = F.array(*[F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)])
    return F.get(bytes_, i)


def with_heavy(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """``left`` joined with ``right``, which has each key once with ``_n``, its rows in ``left``, of some n.

    Keys of a ``HEAVY``-th of n rows or more, a small multiple of ``HEAVY`` at most, are broadcast, and their rows stay where
    they are; only rows of other keys are shuffled.
    """
    heavy = F.broadcast(right.where(F.col("_n") >= max(2, n // HEAVY)).drop("_n"))
    light = left.join(heavy.select(key), key, "left_anti").join(right.drop("_n"), key)
    return left.join(heavy, key).unionByName(light)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge; the root is the smallest node."""

    def star(pairs: DataFrame, large: bool, n: int) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        least = stored(least, "cc-least")
        joined = with_heavy(both, least, "a", n)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return stored(out.where("a <> b").distinct(), "cc")

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while (now := mark(pairs)) != before and now[0]:
        before = now
        pairs = star(star(pairs, True, now[0]), False, now[0])
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b")).distinct()


def near_duplicates(rows: DataFrame) -> DataFrame:
    """Add ``component_id`` and ``root``, the component's least fingerprint, to stored rows with ``doc_id`` and ``fp``."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "fingerprints")
    roots = components(link_edges(distinct))
    by_root = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("_n").alias("_copies"))
    by_root = stored(by_root, "roots")
    # Two numbers.
    n, n_rows = by_root.agg(F.count("*"), F.coalesce(F.sum("_copies"), F.lit(0))).first()
    least = stored(by_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")), "roots")
    known = with_heavy(by_root.drop("least"), least, "root", n).withColumnRenamed("_copies", "_n")
    known = stored(known.select("fp", "root", "component_id", "_n"), "roots")
    return with_heavy(rows, known, "fp", n_rows).select(*rows.columns, "component_id", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the least id of each component, one a component."""
    columns = docs.columns
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    marked = near_duplicates(stored(fingerprints(rows, ("_row", "doc_id")), "simhash"))
    first = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(stored(fingerprints(docs), "simhash"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
