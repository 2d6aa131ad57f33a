"""Tables from files: events of several runs, segment lists, ranges, logs and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Events ``time, stat, var`` of all files, one after another."""
    return spark.read.schema("time double, stat double, var double").parquet(*paths)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_blocks(spark: SparkSession, path: str, detectors: list[str] | None = None, segments: tuple[int, int] | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """Blocks of a stored series: all, or of some detectors, and from the first to the last segment and block of a range.

    Detectors and segments are folders, so others are not opened; blocks are ordered in the files, so row groups without one are skipped.
    """
    rows = spark.read.schema("block bigint, samples array<double>, det string, seg bigint").parquet(path)
    if detectors is not None:
        rows = rows.where(F.col("det").isin(detectors))
    for column, span in (("seg", segments), ("block", blocks)):
        if span is not None:
            rows = rows.where(F.col(column).between(*span))
    return rows


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The lookup table of a data set in shards."""
    return spark.read.parquet(f"{path}/lookup")


def read_samples(spark: SparkSession, path: str, lookup: DataFrame) -> DataFrame:
    """The samples that rows of a lookup table point to, by class, shard and place; classes and shards are folders."""
    data = spark.read.parquet(f"{path}/data").withColumns({"class": F.col("class").cast("string"), "shard": F.col("shard").cast("long")})
    keys = {"class": F.regexp_extract("path", "class=([^/]*)", 1), "shard": F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long")}
    again = [c for c in data.columns if c in lookup.columns and c != "row"]
    return lookup.withColumns(keys).join(data.drop(*again), ["class", "shard", "row"]).drop("class", "shard")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``seg_id, start, end`` of a CSV whose header leaves the first name blank."""
    return spark.read.schema("seg_id int, start bigint, end bigint").option("header", True).option("enforceSchema", True).csv(path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``start, end`` of lines with two numbers between white space; other lines are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 2)
    rows = rows.select(parts[0].try_cast("double").cast("bigint").alias("start"), parts[1].try_cast("double").cast("bigint").alias("end"))
    return rows.where("start is not null and end is not null")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A metrics log with four spaces between its fields."""
    return spark.read.schema(schema).option("header", True).option("sep", "    ").csv(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Glitches: ``event_time`` and ``ifo`` of a CSV with these among its columns."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("event_time").cast("double").alias("event_time"), "ifo")
