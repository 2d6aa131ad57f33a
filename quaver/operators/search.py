"""From detector scores to sensitive volume: clusters, matches, false-alarm rates, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions.astro import volume_to_distance
from quaver.operators.ordered import bucketed, neighbours, row_numbers, running_sums

#: Ranks of descending noise stats that give one false alarm a month, a week, a day, 100 and 1000 a month.
FAR_RANKS = (1, 4, 30, 100, 1000)


def clusters(triggers: DataFrame, gap: int) -> DataFrame:
    """One row a cluster of triggers (``event_id, time, stat``), its first greatest.

    A trigger more than ``gap`` after the one before begins a cluster.
    """
    order = [F.col("time"), F.col("event_id")]
    rows = neighbours(bucketed(triggers, order), order, {"_before": F.col("time")})
    starts = F.when(F.col("_before").isNull() | (F.col("time") - F.col("_before") > gap), 1).otherwise(0).cast("long")
    rows = running_sums(rows, order, {"cluster_id": starts})
    best = F.min_by(F.struct("event_id", "time", "stat"), F.struct(-F.col("stat"), F.col("time"), F.col("event_id")))
    return rows.groupBy("cluster_id").agg(best.alias("b"), F.count("*").alias("n")).select("cluster_id", "b.*", "n")


def nearest_injection(triggers: DataFrame, injections: DataFrame) -> DataFrame:
    """Add ``inj_id`` and ``dt`` of the nearest injection; midway the later one wins, ends clamp.

    Every trigger gives one row, also of a null or repeated id: its columns travel with it.
    Triggers and injections without a time, and any trigger where there is no injection, have nulls.
    """
    timed = injections.where("tc is not null")
    nothing = F.lit(None).cast("struct<tc:bigint,inj_id:bigint>")
    left = triggers.select("time", F.lit(1).alias("_kind"), F.col("event_id").alias("_id"), nothing.alias("_inj"), F.struct(*triggers.columns).alias("_row"))
    right = timed.select(F.col("tc").alias("time"), F.lit(0).alias("_kind"), F.col("inj_id").alias("_id"), F.struct("tc", "inj_id").alias("_inj"))
    order = [F.col("time"), F.col("_kind"), F.col("_id")]
    rows = bucketed(left.where("time is not null").unionByName(right, allowMissingColumns=True), order)
    rows = neighbours(rows, order, {"_l": F.col("_inj")}, {"_r": F.col("_inj")}).where("_kind = 1")
    earlier = F.col("_l").isNotNull() & (F.col("_r").isNull() | (F.col("time") - F.col("_l.tc") < F.col("_r.tc") - F.col("time")))
    pick = F.when(earlier, F.col("_l")).otherwise(F.col("_r"))
    rows = rows.select("_row.*", pick.alias("_p"))
    rows = rows.select(*triggers.columns, F.col("_p.inj_id").alias("inj_id"), F.abs(F.col("time") - F.col("_p.tc")).alias("dt"))
    return rows.unionByName(triggers.where("time is null"), allowMissingColumns=True)


def true_positive(var: int) -> Column:
    return F.coalesce(F.col("dt") <= var, F.lit(False))


def best_true_positives(matched: DataFrame, var: int) -> DataFrame:
    return matched.where(true_positive(var)).groupBy("inj_id").agg(F.max("stat").alias("stat"))


def false_alarm_rates(noise: DataFrame, duration: float) -> DataFrame:
    """Add ``rank`` (1 for the greatest, ties by id) and ``far``, 0 for the greatest."""
    order = [F.desc("stat"), F.col("event_id")]
    rows = row_numbers(bucketed(noise, order), order)
    return rows.select(*noise.columns, "rank", ((F.col("rank") - 1) / F.lit(duration)).alias("far"))


def far_levels(noise: DataFrame) -> DataFrame:
    return false_alarm_rates(noise, 1.0).where(F.col("rank").isin(*FAR_RANKS)).select("rank", "stat")


def found_curve(noise: DataFrame, found: DataFrame) -> DataFrame:
    """For each noise stat, how many found injections (``stat, mc``) are louder, and their weighted sums.

    Weights are decimals, so that sums do not depend on their order.
    """
    def weight(power: float) -> Column:
        return F.pow("mc", F.lit(power)).cast("decimal(24,6)")

    zero = F.lit(0).cast("decimal(24,6)")
    a = noise.select("event_id", "stat", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"), zero.alias("_m"), zero.alias("_m2"))
    b = found.select(F.lit(None).cast("long").alias("event_id"), "stat", F.lit(1), F.lit(1).cast("long"), weight(2.5), weight(5.0))
    order = [F.desc("stat"), F.col("_kind"), F.col("event_id")]
    rows = running_sums(bucketed(a.union(b), order), order, {"n": F.col("_n"), "m": F.col("_m"), "m2": F.col("_m2")})
    return rows.where("_kind = 0").select("event_id", "stat", "n", F.col("m").cast("double").alias("m"), F.col("m2").cast("double").alias("m2"))


def sensitive_volume(curve: DataFrame, injections: DataFrame, chirp: bool, total_volume: float = 1.0) -> DataFrame:
    """Volume, its error, distance and fraction along a found curve."""
    weight = F.pow(F.lit(1.0) / F.col("mc"), F.lit(2.5)).cast("decimal(24,15)")
    # Three numbers.
    count, top, weights = injections.agg(F.count("*"), F.max("mc"), F.sum(weight).cast("double")).first()
    if not count:
        return curve.select("event_id", "stat", "n", *[F.lit(None).cast("double").alias(c) for c in ("volume", "error", "distance", "fraction")])
    rows = curve
    if chirp:
        scale, total = F.lit(total_volume / (top**2.5 * count)), F.lit(top**2.5 * weights)
        volume, mean, square = scale * F.col("m"), F.col("m") / total, F.col("m2") / total
    else:
        scale, total = F.lit(total_volume / count), F.lit(float(count))
        volume, mean, square = scale * F.col("n"), F.col("n") / total, F.col("n") / total
    error = scale * F.sqrt(F.greatest(F.lit(0.0), total * (square - mean * mean)))
    return rows.select("event_id", "stat", "n", volume.alias("volume"), error.alias("error"), volume_to_distance(volume).alias("distance"), (F.col("n") / total).alias("fraction"))
