"""The event search's clusters and counts over streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_peaks(stream: DataFrame, by: list[str], gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """One row a session of ``ts, stat`` and each key: its span, size and greatest stat.

    A session window also joins rows that lie exactly the gap apart. Spark keeps sessions by key, so there is one at least.
    """
    rows = stream.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.max("stat").alias("stat")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "stat")


def hopping_counts(stream: DataFrame, by: list[str], size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """One row a window of ``size`` that begins at each ``step``, and each key: its start, size and greatest stat."""
    rows = stream.withWatermark("ts", late).groupBy(*by, F.window("ts", size, step).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.max("stat").alias("stat")).select(*by, F.col("w.start").alias("start"), "n", "stat")
