"""What an epoch's validation shows: detected shares by parameter, and parameters by score band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.operators.ordered import bucketed, running_sums
from quaver.operators.quantiles import quantiles


def edges_of(rows: DataFrame, column: str, bins: int) -> list[float] | None:
    """Equal-width edges from the least to the greatest value."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return None if low is None else [low + (high - low) * i / bins for i in range(bins)] + [high]


def detected_by_bin(scores: DataFrame, parameter: str, bins: int = 4) -> DataFrame:
    """``bin, score, fraction``: for each noise score, the share of each bin's signals strictly above it.

    ``scores`` is ``score, target`` and a parameter of signals. Bins are of equal width and open at both ends, so a signal
    on an edge is in none; a bin without signals has no rows.
    """
    signals = scores.where("target = 1")
    edges = edges_of(signals, parameter, bins)
    if edges is None:
        return scores.select(F.lit(0).alias("bin"), "score", F.lit(0.0).alias("fraction")).limit(0)
    inside = [(F.col(parameter) > a) & (F.col(parameter) < b) for a, b in zip(edges, edges[1:])]
    counts = signals.agg(*[F.count(F.when(c, 1)).alias(f"b{i}") for i, c in enumerate(inside)]).first()
    # Noise of a score comes before the signals that have it.
    rows = scores.select("score", "target", *[((F.col("target") == 1) & c).cast("long").alias(f"_in{i}") for i, c in enumerate(inside)]).fillna(0, [f"_in{i}" for i in range(bins)])
    rows = rows.groupBy("score", "target").agg(*[F.sum(f"_in{i}").alias(f"_in{i}") for i in range(bins)])
    order = [F.desc("score"), F.col("target")]
    rows = running_sums(bucketed(rows, order), order, {f"n{i}": F.col(f"_in{i}") for i in range(bins)}).where("target = 0")
    shares = [F.struct(F.lit(i).alias("bin"), (F.col(f"n{i}") / counts[i]).alias("fraction")) for i in range(bins) if counts[i]]
    return rows.select("score", F.inline(F.array(*shares))).select("bin", "score", "fraction")


def score_bands(scores: DataFrame) -> dict[int, tuple[float, float]]:
    """Seven ranges of raw scores between the least signal, zero, the greatest noise, the median of the signals above it, and the greatest signal."""
    signals, noise = scores.where("target = 1"), scores.where("target = 0")
    least, greatest = signals.agg(F.min("score"), F.max("score")).first()
    top = noise.agg(F.max("score")).first()[0]
    if least is None or top is None:
        return {}
    above = quantiles(signals.where(F.col("score") > top), [], "score", [0.5]).first()
    middle = above["v"] if above else float("nan")
    pairs = [(least, 0.0), (least, top), (0.0, top), (top, greatest), (top, middle), (middle, greatest), (0.0, greatest)]
    return dict(enumerate(pairs))


def banded_histograms(scores: DataFrame, parameters: list[str], bins: int = 100) -> DataFrame:
    """``band, parameter, bin, n``: histograms of the signals' parameters in each band of scores, and of all signals as band -1.

    A band is open at both ends. Each histogram spans its own values, the last bin closed; empty bins are left out.
    """
    bands = score_bands(scores)
    inside = [F.when((F.col("score") > a) & (F.col("score") < b), F.lit(k)) for k, (a, b) in bands.items()]
    own = F.array_compact(F.array(F.lit(-1), *inside))
    values = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("v")) for p in parameters])
    rows = scores.where("target = 1").select(F.explode(own).alias("band"), values.alias("_v")).select("band", F.inline("_v")).where("v is not null")
    ranges = rows.groupBy("band", "parameter").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    # Eight bands of a few parameters.
    rows = rows.join(F.broadcast(ranges), ["band", "parameter"])
    return rows.groupBy("band", "parameter", _bin(bins).alias("bin")).agg(F.count("*").alias("n"))


def _bin(bins: int) -> Column:
    place = F.floor((F.col("v") - F.col("low")) * F.lit(float(bins)) / (F.col("high") - F.col("low")))
    return F.when(F.col("high") > F.col("low"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
