"""Distributions, seeds and losses as columns; the draws under them are ``counters``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.operators import counters
from quaver.operators.ordered import bucketed, neighbours, running_sums


def uniform_radius(u: Column, low: float, high: float) -> Column:
    """A distance uniform in volume, from a draw of 0 to 1."""
    return F.pow(F.lit(low**3) + u * F.lit(high**3 - low**3), F.lit(1 / 3))


def sky_position(u: Column, v: Column) -> tuple[Column, Column]:
    """Right ascension and declination, uniform on the sphere, from two draws."""
    return u * F.lit(2 * math.pi), F.asin(2 * v - 1)


def ordered_masses(u: Column, v: Column, low: float, high: float) -> tuple[Column, Column]:
    """Two uniform masses, the greater first."""
    return F.lit(low) + F.lit(high - low) * F.greatest(u, v), F.lit(low) + F.lit(high - low) * F.least(u, v)


def sample_seed(epoch: int, n: int, index: Column, offset: int = 0) -> Column:
    """A seed of each sample and epoch that no other has."""
    return F.lit(epoch * n + 1 + offset) + index


def annealed(epochs: DataFrame, epoch: str, start: int, end: int, first: float, last: float) -> Column:
    """A mode's probability: ``first`` up to ``start``, on a line to ``last`` in the epoch before ``end``, ``last`` from there."""
    step = (last - first) / max(1, end - start - 1)
    at = F.col(epoch)
    return F.when(at < start, F.lit(first)).when(at >= end, F.lit(last)).otherwise(F.lit(first) + (at - start) * F.lit(step))


def by_duration(df: DataFrame, id_: str, segments: DataFrame, seed: int) -> DataFrame:
    """``id, seg_id, at_second``: for each row a segment, with a chance in proportion to its length, and a place in it.

    Segments are laid end to end in the order of their ids; a draw of the whole length falls into one. Draws and segments meet
    in one order of places. Segments without length are never chosen, and without any there are no rows.
    """
    laid = segments.where("end > start").select("seg_id", "start", "end")
    order = [F.col("seg_id"), F.col("start")]
    laid = running_sums(bucketed(laid, order), order, {"_upto": F.col("end") - F.col("start")})
    total = laid.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    starts = laid.select((F.col("_upto") - F.col("end") + F.col("start")).alias("_at"), F.lit(0).alias("_kind"), F.struct("seg_id", "start", "end").alias("_seg"))
    asked = df.select(counters.whole(F.col(id_), seed, total).alias("_at"), F.lit(1).alias("_kind"), F.col(id_))
    along = [F.col("_at"), F.col("_kind"), F.col(id_)]
    rows = neighbours(bucketed(starts.unionByName(asked, allowMissingColumns=True), along), along, {"_s": F.col("_seg")}).where("_kind = 1 and _s is not null")
    offset = counters.whole(F.col(id_), seed, F.col("_s.end") - F.col("_s.start"), stream=1)
    return rows.select(id_, "_s.seg_id", (F.col("_s.start") + offset).alias("at_second"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def masked_mean(value: Column, target: Column) -> Column:
    """Mean over rows whose target is not the noise sentinel, negative."""
    return F.avg(F.when(target >= 0, value))


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")
