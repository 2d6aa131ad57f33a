"""A segment budget: pick, trim and skip segments in order until a duration is covered.

Segments are taken in the order of their ids. The running duration before a segment says
whether it is skipped (before the offset), begins late (where the offset falls into it),
is taken, ends early (where the duration is reached) or comes too late. Only two
segments are ever trimmed, so the running duration is a running sum in three stretches:
it is summed over ranges of the order, one row a range passes on, and the two
segments where a stretch ends come to the driver as a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.operators.ordered import bucketed, row_numbers, running_sums


def _stretch(segments: DataFrame, offset: int, minimum: int | None, slide: int) -> DataFrame:
    """Segments from where the offset is reached, with ``_past``, the duration before each; trimmed and dropped there."""
    length = F.col("end") - F.col("start")
    rows = segments.select("seg_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    if minimum is not None:
        rows = rows.where(length - slide >= minimum)
    order = [F.col("seg_id"), F.col("start"), F.col("end")]
    rows = running_sums(row_numbers(bucketed(rows, order), order, "_rn"), order, {"_upto": length - slide})
    rows = rows.withColumn("_past", F.col("_upto") - (length - slide))
    at = rows.where(F.col("_past") + length >= offset).agg(F.min_by(F.struct("_rn", "_past", "start", "end"), "_rn").alias("r")).first()["r"]
    if at is None:
        return rows.limit(0).drop("_upto", "_bucket")
    late = max(0, offset - at["_past"])
    begin, base = at["start"] + late, at["_past"] + late
    first = F.col("_rn") == at["_rn"]
    kept = at["end"] - begin - slide if minimum is None or at["end"] - begin - slide >= minimum else None
    # After the first segment the sums go on from what it gave.
    moved = base + (kept or 0) - (at["_past"] + at["end"] - at["start"] - slide)
    rows = rows.where(F.col("_rn") >= at["_rn"]) if kept is not None else rows.where(F.col("_rn") > at["_rn"])
    return rows.select("seg_id", F.when(first, F.lit(begin)).otherwise(F.col("start")).alias("start"), "end", "_rn", F.when(first, F.lit(base)).otherwise(F.col("_past") + moved).alias("_past"))


def testing(segments: DataFrame, duration: int, offset: int = 0, minimum: int | None = None, slide: int = 0, buffer: int = 8) -> DataFrame:
    """``seg_id, start, end`` of the segments that cover ``duration`` after ``offset``.

    A segment counts ``end - start - slide``. Where the duration is reached within a segment, it ends there and ``buffer`` later.
    Whole numbers; ids order the segments. Null bounds are left out. No segments give none.
    """
    if buffer < 0 or duration <= 0:
        raise ValueError("buffer is not negative and duration is positive")
    rows = _stretch(segments.where("start is not null and end is not null"), offset, minimum, slide)
    length = F.col("end") - F.col("start")
    over = F.col("_past") + length - slide - (offset + duration)
    full, late = rows.agg(F.min(F.when(over > 0, F.col("_rn"))), F.min(F.when(F.col("_past") - offset >= duration, F.col("_rn")))).first()
    if late is not None:
        rows = rows.where(F.col("_rn") < late)
    if full is not None:
        rows = rows.where(F.col("_rn") <= full)
    return rows.select("seg_id", "start", (F.col("end") - F.when(over > 0, over - buffer).otherwise(0)).alias("end"))


def training(segments: DataFrame, tested: DataFrame, offset: int = 0, minimum: int | None = None, slide: int = 0, buffer: int = 8) -> DataFrame:
    """What ``testing`` leaves after the offset; of its last segment the part from ``buffer`` after its end, if there is more than that."""
    rows = _stretch(segments.where("start is not null and end is not null"), offset, minimum, slide)
    last = tested.agg(F.max_by(F.struct("start", "end"), F.struct("seg_id", "start")).alias("r")).first()["r"]
    rows = rows.select("seg_id", "start", "end").join(tested.select("start", "end"), ["start", "end"], "left_anti")
    if last is None:
        return rows.select("seg_id", "start", "end")
    cut = F.col("start") == last["start"]
    rows = rows.where(~cut | (F.col("end") - last["end"] > buffer))
    return rows.select("seg_id", F.when(cut, F.lit(last["end"] + buffer)).otherwise(F.col("start")).alias("start"), "end")
