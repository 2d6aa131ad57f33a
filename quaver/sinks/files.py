"""Result tables as files: events, evaluations, blocks of samples, logs and segment lists."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_events(events: DataFrame, path: str) -> None:
    """Cluster representatives: ``time, stat, var``. An existing path is an error."""
    events.select("time", "stat", "var").write.mode("errorifexists").parquet(path)


def write_evaluation(rows: DataFrame, path: str, force: bool = False) -> None:
    """One evaluation; an existing path is an error unless ``force`` replaces it."""
    rows.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Sample blocks with ``det`` and ``seg``, a folder for each detector and segment; ranges of ``block`` split a long one over tasks."""
    order = [c for c in ("det", "seg", "block") if c in blocks.columns]
    blocks.repartitionByRange(*order).write.mode("errorifexists").partitionBy("det", "seg").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Metrics of an epoch, as lines with a header and four spaces between fields."""
    rows.write.mode("append").option("header", True).option("sep", "    ").csv(path)


def write_segments(segments: DataFrame, path: str) -> None:
    """``seg_id, start, end`` as CSV; the first column's name is blank in the header."""
    segments.select("seg_id", "start", "end").toDF("", "start", "end").write.mode("errorifexists").option("header", True).csv(path)
