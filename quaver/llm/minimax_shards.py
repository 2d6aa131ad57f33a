"""Minimax contiguous partition of atomic groups into shards.

Groups of rows with equal texts stay whole and are ordered by a 64-bit hash of
the text. The smallest capacity for which a greedy pass needs no more than the
wanted number of shards is found by binary search, and the groups are cut where
that pass cuts. The driver holds a histogram of the key space only: bins of
bounded number, split further by a Spark job wherever a cut may still fall
inside one, until every bin that matters is a single group. A row's shard then
follows from its key and the cut keys, without a join.

Defined results: a null text counts as an empty one; an empty table gives an
empty result; repeated rows each get a slot of their own; ties in the order go
by id, nulls first; shards beyond the last cut stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.common import partitions, stored

#: Bins that the driver asks for in one go, at most.
BINS = 1 << 14


def greedy(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Positions after each shard's last atom; ``ends`` are running totals."""
    cuts, start = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, start + capacity, "right"))
        cuts.append(at)
        start = int(ends[at - 1]) if at else 0
    return np.array(cuts)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search of the least capacity that ``shards`` greedy shards need."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes, dtype=np.int64)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards)[-1] == len(sizes):
            high = middle
        else:
            low = middle + 1
    return low


def _unsettled(sizes: np.ndarray, single: np.ndarray, largest: int, shards: int, high: int) -> np.ndarray:
    """Bins of several groups in which a cut can fall at some capacity still possible."""
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    low = max(largest, -(-int(ends[-1]) // shards))
    early, late, touched = 0, 0, np.zeros(len(sizes), bool)
    for _ in range(shards):
        at = int(np.searchsorted(ends, early + low, "right"))
        early = int(ends[at - 1]) if at else 0
        late = min(late + high, int(ends[-1]))
        touched |= (ends > early) & (starts < late)
        inside = int(np.searchsorted(ends, late, "left"))
        if inside < len(sizes) and single[inside] and ends[inside] > late:
            late = int(starts[inside])
    return np.flatnonzero(touched & ~single)


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First key of each shard after the first, and the capacity.

    ``groups`` has one row a key: ``key`` long and ``bytes`` long.
    """

    def bins(df: DataFrame, shift: int) -> list:
        rows = df.groupBy(F.shiftright("key", shift).alias("bin")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("top")
        )
        return [(r["bin"] << shift, shift, int(r["bytes"]), r["n"], int(r["top"])) for r in rows.collect()]

    atoms = bins(groups, 64 - BINS.bit_length() + 1)
    while True:
        atoms.sort()
        if not atoms:
            return [], 0
        sizes = np.array([a[2] for a in atoms], dtype=np.int64)
        single = np.array([a[3] == 1 or a[1] == 0 for a in atoms])
        high = smallest_capacity(sizes, shards)
        open_ = _unsettled(sizes, single, max(a[4] for a in atoms), shards, high)
        if not len(open_):
            cuts = greedy(np.cumsum(sizes), high, shards)[:-1]
            return [atoms[c][0] if c < len(atoms) else None for c in cuts], high
        split = [atoms[i] for i in open_]
        atoms = [a for i, a in enumerate(atoms) if i not in set(open_.tolist())]
        for shift in sorted({a[1] for a in split}):
            here = [a[0] >> shift for a in split if a[1] == shift]
            finer = max(0, shift - max(1, (BINS * 8 // len(here)).bit_length() - 1))
            wanted = groups.sparkSession.createDataFrame([(b,) for b in here], "open_bin long")
            atoms += bins(groups.join(F.broadcast(wanted), F.shiftright("key", shift) == F.col("open_bin"), "left_semi"), finer)


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with ``key``, ``size`` and ``doc_id``.

    Slots run from 0 in each shard in order of (key, doc_id): rows are dealt by
    ranges of that pair, so equal keys may spread over tasks, and each task's
    first slots come from a table of one row a task and shard.
    """
    spark = rows.sparkSession
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts, capacity = cut_keys(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        if cut is not None:
            shard = shard + F.when(F.col("key") >= F.lit(cut).cast("long"), 1).otherwise(0)
    dealt = rows.repartitionByRange(partitions(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    dealt = stored(
        dealt.select("*", shard.cast("int").alias("shard"), F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at")),
        "shard-rows",
    )
    runs = dealt.groupBy("shard", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(_by_task()) - F.col("_n")
    runs = runs.select("shard", "_task", "_first", before.alias("_before"))
    out = dealt.join(F.broadcast(runs), ["shard", "_task"])
    slot = F.col("_at") - F.col("_first") + F.col("_before")
    return out.select(*rows.columns, "shard", slot.cast("long").alias("slot"), F.lit(capacity).cast("long").alias("capacity"))


def _by_task():
    from pyspark.sql import Window

    return Window.partitionBy("shard").orderBy("_task")


def shard_documents(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """Shard rows with ``doc_id`` and a text; equal texts share a shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("key"),
    )
    return assign(stored(rows, "shard-sizes"), shards)


def op2_minimax_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_documents(docs, 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "capacity",
    )
