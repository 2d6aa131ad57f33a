"""Interval algebra on ``start, end`` tables of long values, by sweeps over sorted bounds.

A sweep puts the bounds of both sides in one order and carries what is open from range to range
of it (``ordered``): no pair of an interval and a point or another interval is ever tried, and a
long interval is two rows, whatever it spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.operators.ordered import bucketed, neighbours, row_numbers, running_sums
from quaver.session import stored

#: Intervals of one side that are paired in one tile; it does not bear on the result.
TILE = 4096


def points_in(points: DataFrame, intervals: DataFrame, at: str) -> DataFrame:
    """Points in any interval, ends included, each once; rows that repeat stay, points without a place are in none."""
    whole = coalesce(intervals.select("start", "end"))
    starts = whole.select(F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("end").alias("_end"))
    rows = points.where(F.col(at).isNotNull()).select(F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    order = [F.col("_at"), F.col("_kind")]
    rows = neighbours(bucketed(starts.unionByName(rows, allowMissingColumns=True), order), order, {"_held": F.col("_end")})
    return rows.where("_kind = 1 and _at <= _held").select("_row.*")


def band_max(points: DataFrame, at: str, events: DataFrame, reach: int) -> DataFrame:
    """Add the greatest ``stat`` of events within ``reach`` of a point, minus infinity without one.

    Every point gives one row, whatever of it is null or repeated. Bands and events meet in buckets as wide
    as a band, each place and each time once.
    """
    width = max(1, 2 * reach)
    places = points.where(F.col(at).isNotNull()).select(F.col(at).alias("_at")).distinct()
    buckets = F.sequence(F.expr(f"floor((_at - {reach}) / {width})"), F.expr(f"floor((_at + {reach}) / {width})"))
    held = places.withColumn("_b", F.explode(buckets))
    loudest = events.where("time is not null").groupBy("time").agg(F.max("stat").alias("stat")).withColumn("_b", F.expr(f"floor(time / {width})"))
    best = held.join(loudest, "_b").where(F.abs(F.col("time") - F.col("_at")) <= reach).groupBy("_at").agg(F.max("stat").alias("best"))
    out = points.join(best, F.col(at) == F.col("_at"), "left")
    return out.select(*[points[c] for c in points.columns], F.coalesce("best", F.lit(-math.inf)).alias("best"))


def coalesce(intervals: DataFrame) -> DataFrame:
    """Touching and overlapping intervals as one."""
    order = [F.col("start"), F.col("end")]
    rows = bucketed(intervals.where("start <= end"), order)
    starts = F.when(F.col("start") <= F.col("_top"), 0).otherwise(1).cast("long")
    rows = running_sums(_with_top(rows, order), order, {"island": starts})
    return rows.groupBy("island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end")


def _with_top(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add to a bucketed table ``_top``, the greatest end of all rows before."""
    within = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_bucket").agg(F.max("end").alias("_t"))
    tops = tops.select("_bucket", F.max("_t").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_t"))
    rows = rows.withColumn("_own", F.max("end").over(within)).join(F.broadcast(tops), "_bucket")
    return rows.withColumn("_top", F.greatest("_own", "_t")).drop("_own", "_t")


def _swept(left: DataFrame, right: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Pieces between consecutive bounds of two lists of disjoint intervals: ``a, b``, what is open of each, and the last ids that began."""

    def bounds(df: DataFrame, side: str) -> DataFrame:
        row = df.select("start", "end", *[c for c in carried if c in df.columns])
        both = F.array(F.struct(F.col("start").alias("a"), F.lit(1).alias("_step")), F.struct(F.col("end").alias("a"), F.lit(-1).alias("_step")))
        return row.select(*row.columns, F.inline(both), F.lit(side).alias("_side"))

    rows = bounds(left, "l").unionByName(bounds(right, "r"), allowMissingColumns=True)
    # Ends before starts: at one place the last row knows all that is open there.
    order = [F.col("a"), F.col("_step"), F.col("_side"), F.col("start"), F.col("end")]
    rows = bucketed(rows, order)
    rows = running_sums(rows, order, {"in_left": F.when(F.col("_side") == "l", F.col("_step")).otherwise(0), "in_right": F.when(F.col("_side") == "r", F.col("_step")).otherwise(0)})
    starts = {k: F.when(F.col("_step") == 1, v) for k, v in carried.items()}
    rows = neighbours(rows, order, {f"_p_{k}": v for k, v in starts.items()}, {"b": F.col("a")})
    return rows.select("a", "b", "in_left", "in_right", *[F.coalesce(starts[k], F.col(f"_p_{k}")).alias(k) for k in carried])


def intersect(left: DataFrame, right: DataFrame, least: int = 1) -> DataFrame:
    """Common parts, of ``least`` length at least, of two lists (``left_id``, ``right_id``) of disjoint intervals; no more parts than bounds."""
    rows = _swept(left.where("start < end"), right.where("start < end"), {"left_id": F.col("left_id"), "right_id": F.col("right_id")})
    rows = rows.where(f"in_left > 0 and in_right > 0 and b - a >= {max(1, least)}")
    return rows.select("left_id", "right_id", F.col("a").alias("start"), F.col("b").alias("end"))


def overlaps(left: DataFrame, right: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """All pairs of two lists (``left_id``, ``right_id``) of intervals with a common part, and that part.

    Intervals of one list may overlap. Those of both meet in buckets of ``width``, about an interval's length,
    and each pair in the one where its part begins. A bucket of very many intervals is cut into tiles of so many of
    each side, so a task holds no more than a tile's, and a bucket of any size goes to as many tasks as its pairs need.
    """

    def placed(df: DataFrame, side: str) -> DataFrame:
        buckets = F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))
        return stored(df.where("start < end").select(side, "start", "end", F.explode(buckets).alias("_b")), "overlaps")

    def tiled(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        rows = df.join(cuts, "_b").withColumn(own, F.pmod(F.xxhash64(side, "start", "end"), f"_n{own}"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1)))
        return rows.select("_b", "_l", "_r", side, F.col("start").alias(f"_s{own}"), F.col("end").alias(f"_e{own}"))

    left, right = placed(left, "left_id"), placed(right, "right_id")
    needed = [df.groupBy("_b").agg(F.ceil(F.count("*") / tile).alias(name)) for df, name in ((left, "_n_l"), (right, "_n_r"))]
    cuts = stored(needed[0].join(needed[1], "_b"), "overlaps-cuts")
    pairs = tiled(left, "left_id", "_l", "_r").join(tiled(right, "right_id", "_r", "_l"), ["_b", "_l", "_r"])
    pairs = pairs.select("_b", "left_id", "right_id", F.greatest("_s_l", "_s_r").alias("start"), F.least("_e_l", "_e_r").alias("end"))
    return pairs.where(f"start < end and start div {width} = _b").drop("_b")


def subtract(intervals: DataFrame, vetoes: DataFrame, least: int) -> DataFrame:
    """What vetoes leave of disjoint intervals, in pieces longer than ``least``."""
    rows = _swept(intervals.select("start", "end").where("start < end"), coalesce(vetoes.select("start", "end")), {})
    rows = rows.where(f"in_left > 0 and in_right = 0 and b - a > {least}")
    return rows.select(F.col("a").alias("start"), F.col("b").alias("end"))


def offsets(intervals: DataFrame) -> DataFrame:
    """Add ``offset``, the summed length of the intervals before."""
    size = F.col("end") - F.col("start")
    order = [F.col("start"), F.col("seg_id")]
    rows = running_sums(bucketed(intervals, order), order, {"_upto": size})
    return rows.select(*intervals.columns, (F.col("_upto") - size).alias("offset"))


def first_containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """For each inner interval the first outer one around it, by start and id; ``raw_id`` is null without one.

    In order of start only an outer interval that ends later than all before it can be the first around
    anything: these ends rise like a staircase, and the first step that an inner end does not pass is the answer,
    if it begins early enough.
    """
    order = [F.col("start"), F.col("seg_id")]
    steps = _with_top(bucketed(outer.where("start <= end").select("seg_id", "start", "end"), order), order).where("_top is null or end > _top")
    steps = steps.select(F.col("end").alias("_at"), F.lit(1).alias("_kind"), F.struct("seg_id", "start").alias("_step"))
    asked = inner.select("seg_id", "start", "end")
    known = asked.where("start is not null and end is not null")
    rows = known.select(F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.struct("seg_id", "start", "end").alias("_row"))
    along = [F.col("_at"), F.col("_kind"), F.col("_row.seg_id")]
    rows = neighbours(bucketed(steps.unionByName(rows, allowMissingColumns=True), along), along, {}, {"_next": F.col("_step")}).where("_kind = 0")
    out = rows.select("_row.*", F.when(F.col("_next.start") <= F.col("_row.start"), F.col("_next.seg_id")).alias("raw_id"))
    return out.unionByName(asked.where("start is null or end is null"), allowMissingColumns=True)


def gaps(intervals: DataFrame) -> DataFrame:
    """Each interval with the end before and the start after it, in order of start."""
    order = [F.col("start"), F.col("seg_id")]
    rows = neighbours(bucketed(intervals, order), order, {"end_before": F.col("end")}, {"start_after": F.col("start")})
    return rows.drop("_bucket")


def overlapping(intervals: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one has ended; an empty result says that the list is disjoint."""
    order = [F.col("start"), F.col("end"), F.col("seg_id")]
    rows = _with_top(bucketed(intervals.where("start <= end"), order), order)
    return rows.where("start < _top").select(*intervals.columns)


def numbered(intervals: DataFrame) -> DataFrame:
    """Add ``number``, from 0 in order of start."""
    order = [F.col("start"), F.col("seg_id")]
    rows = row_numbers(bucketed(intervals, order), order, "_n")
    return rows.select(*intervals.columns, (F.col("_n") - 1).alias("number"))


def holding(intervals: DataFrame, points: DataFrame, at: str) -> DataFrame:
    """Intervals, each once, that hold a point, ends included; empty if a veto has done its work.

    The first point that does not come before an interval's start decides.
    """
    rows = intervals.where("start <= end").select(F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct(*intervals.columns).alias("_row"))
    places = points.where(F.col(at).isNotNull()).select(F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"))
    order = [F.col("_at"), F.col("_kind"), F.col("_row.seg_id")]
    swept = neighbours(bucketed(rows.unionByName(places, allowMissingColumns=True), order), order, {}, {"_next": F.when(F.col("_kind") == 1, F.col("_at"))})
    return swept.where("_kind = 0 and _next <= _row.end").select("_row.*")
