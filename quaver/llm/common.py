"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.session import new_path, remove, shared_folder, stored

__all__ = ["WHITE", "arrow_rows", "ascii_lower", "forget", "new_path", "partitions", "read", "remove", "shared_folder", "small_batches", "stored", "words"]

#: ASCII white space, as the contracts' word patterns exclude it.
WHITE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(*frames: DataFrame) -> None:
    """Delete stored tables that nothing will read again, and let Spark drop the shuffles of jobs that are over."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)
    gc.collect()
    # Spark cleans up after what the driver's virtual machine has found to be garbage.
    SparkSession.active().sparkContext._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send so many rows in a batch to Python; the session's own number comes back after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` in a text."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
