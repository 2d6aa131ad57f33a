"""Roles of a detector search, read from the driver's tables.

Times are whole microseconds since the epoch, so comparisons are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.session import table

SECOND = 1_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("ts is not null and value is not null")
    return rows.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.col("value").alias("stat"))


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type <> 'purchase'").select("event_id", "time", "stat", "user_id")


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'view'").select("event_id", "time", "stat")


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inj_id, tc, mass1, mass2, mc, snr``."""
    from quaver.functions.astro import chirp_mass

    rows = events(spark, sf_dir).where("event_type = 'purchase'")
    a, b = F.col("event_id") % 44, (F.col("event_id") * 7) % 44
    rows = rows.select(
        F.col("event_id").alias("inj_id"),
        F.col("time").alias("tc"),
        (F.greatest(a, b) + 7).cast("double").alias("mass1"),
        (F.least(a, b) + 7).cast("double").alias("mass2"),
        (130 + (F.col("event_id") * 13) % 221).cast("double").alias("chirp_distance"),
        (5 + F.col("event_id") % 11).alias("snr"),
    )
    return rows.withColumn("mc", chirp_mass(F.col("mass1"), F.col("mass2")))


def segments(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Spans ``key, start, end`` of each value of an expression over events."""
    rows = events(spark, sf_dir).groupBy(F.expr(key).alias("seg_id"))
    return rows.agg(F.min("time").alias("start"), F.max("time").alias("end"))


#: Strain of two detectors: samples a block, and how far apart samples and segments are.
DETECTORS, BLOCK, TICK, APART = ("H1", "L1"), 64, 500_000, 1_000_000_000_000


def strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks ``det, seg, block, samples`` of two detectors, written once: values in the order of their events."""
    from quaver.operators.series import blocks_of
    from quaver.session import stored

    det = F.when(F.col("event_id") % 2 == 0, DETECTORS[0]).otherwise(DETECTORS[1])
    rows = events(spark, sf_dir).where("user_id is not null").select(det.alias("det"), (F.col("user_id") % 16).alias("seg"), "event_id", "stat")
    return stored(blocks_of(rows, "event_id", "stat", BLOCK), "strain")


def extents(blocks: DataFrame) -> DataFrame:
    """``det, seg, start, n`` in samples; the second detector begins later, differently in each segment."""
    from quaver.operators.series import lengths

    later = F.when(F.col("det") == DETECTORS[1], F.col("seg") * 7 % 11).otherwise(0).cast("long")
    return lengths(blocks).select("det", "seg", later.alias("start"), "n")


#: The same roles for an SQL engine.
SQL = """
ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS time, value AS stat FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
trig AS (SELECT event_id, time, stat, user_id FROM ev WHERE event_type <> 'purchase'),
bg AS (SELECT event_id, time, stat FROM ev WHERE event_type = 'view'),
inj0 AS (SELECT event_id AS inj_id, time AS tc, (7 + greatest(event_id % 44, (event_id * 7) % 44))::DOUBLE AS mass1,
    (7 + least(event_id % 44, (event_id * 7) % 44))::DOUBLE AS mass2, (130 + (event_id * 13) % 221)::DOUBLE AS chirp_distance,
    5 + event_id % 11 AS snr FROM ev WHERE event_type = 'purchase'),
inj AS (SELECT *, pow(mass1 * mass2, 0.6) / pow(mass1 + mass2, 0.2) AS mc FROM inj0)
"""
STRAIN = """
smp AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'H1' ELSE 'L1' END AS det, user_id % 16 AS seg,
    row_number() OVER (PARTITION BY event_id % 2, user_id % 16 ORDER BY event_id, stat) - 1 AS pos, stat AS v FROM ev WHERE user_id IS NOT NULL),
ln AS (SELECT det, seg, count(*) AS n FROM smp GROUP BY ALL),
cm AS (SELECT seg, min(n) AS n FROM ln GROUP BY seg HAVING count(*) = 2),
ext AS (SELECT det, seg, CASE WHEN det = 'L1' THEN seg * 7 % 11 ELSE 0 END AS start, n FROM ln)
"""
