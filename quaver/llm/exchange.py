"""Keys that blocks of rows send to the buckets of a key space, and the answers that they get.

A block is a run of rows that one task has gathered: it knows its distinct keys,
sorted, and a few numbers for each. ``messages`` cuts them into the buckets' ranges,
``tallied`` adds up each key over all blocks and answers every block for the keys
that it sent, in their order. A key that all rows share costs one entry a block, so
no key makes a task hot; nothing is broadcast, and nothing reaches the driver but
one row a bucket of totals.

Buckets are as many as keep ``BUCKET_BYTES`` of keys and numbers in each. Keys are
64-bit hashes: two different things with one key are taken for the same, which is
to be expected once among some five billion distinct keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import new_path, partitions, remove, stored

#: Bytes of unpacked keys and numbers that a bucket holds, about.
BUCKET_BYTES = 24 << 20
MESSAGE = "bucket int, block string, keys binary, numbers binary"
ANSWER = "block string, bucket int, numbers binary, total long, known long"


def packed(values: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T if len(values) else values.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def bucket_count(keys: int, width: int = 1) -> int:
    return max(1, -(-keys * (8 + 8 * width) // BUCKET_BYTES))


def messages(block: str, keys: np.ndarray, numbers: np.ndarray, buckets: int) -> pd.DataFrame:
    """``keys`` are distinct and sorted; ``numbers`` has a row for each."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows = [
        (int(k), block, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(numbers[a:b].ravel()))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
        if b > a
    ]
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "numbers"])


def tallied(sent: DataFrame, kind, width: int, verdict: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], tag: str) -> DataFrame:
    """Answers, stored. ``verdict(place, numbers, sums)`` turns a bucket's entries into one number each.

    ``place`` is each entry's key among the bucket's distinct ones, ``numbers`` its own
    row and ``sums`` the rows added up by key. Entries come in order of (block, key),
    so that no result hangs on how rows were dealt. Rows without a block carry
    the bucket's sum of the first number and its count of keys where that is not 0.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        keys = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in frame["keys"]]
        sizes = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        numbers = np.concatenate([unpacked(n, kind) for n in frame["numbers"]]).reshape(-1, width)
        sums = np.stack([np.bincount(place, numbers[:, c], len(distinct)) for c in range(width)], 1)
        values = verdict(place, numbers, sums)
        ends = np.cumsum(sizes)
        bucket = int(frame["bucket"].iloc[0])
        out = [(block, bucket, packed(values[e - s : e]), 0, 0) for block, s, e in zip(frame["block"], sizes, ends)]
        out.append((None, bucket, b"", int(sums[:, 0].sum()), int((sums[:, 0] > 0).sum())))
        return pd.DataFrame(out, columns=["block", "bucket", "numbers", "total", "known"])

    return stored(sent.groupBy("bucket").applyInPandas(run, ANSWER), tag)


def answer(replies: pd.DataFrame, kind) -> np.ndarray:
    """A block's answers in the order of the keys that it sent."""
    parts = [unpacked(x, kind) for x in replies.sort_values("bucket")["numbers"]]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


@contextmanager
def block_table(blocks: DataFrame, tag: str) -> Iterator[DataFrame]:
    """``blocks`` as a table bucketed by block, so that only keys and answers are shuffled; dropped and deleted in the end."""
    spark = blocks.sparkSession
    name, path = f"{tag}_{uuid.uuid4().hex}", new_path(spark, tag)
    try:
        writer = blocks.write.bucketBy(partitions(spark), "block").option("compression", "zstd").option("path", path)
        writer.format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def sent_by(blocks: DataFrame, columns: tuple[str, ...], function: Callable[..., pd.DataFrame]) -> DataFrame:
    """Messages of each block, by ``function(row)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield function(row)

    return blocks.select("block", *columns).mapInPandas(run, MESSAGE)


def answered(blocks: DataFrame, columns: tuple[str, ...], answers: DataFrame, function: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``function(row, replies)`` of each block with its answers."""
    replies = answers.where("block is not null").drop("total", "known")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return function(next(left.itertuples()), right) if len(left) else pd.DataFrame(columns=names)

    return blocks.select("block", *columns).groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)


def totals(answers: DataFrame) -> tuple[int, int]:
    """Sum of the first number over all keys, and keys where it is not 0."""
    row = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    return int(row[0]), int(row[1])
