"""Exact quantiles of groups, by rounds of counts that narrow a rank to a few rows.

A round sketches each open range of values once, takes from the sketch two splitters about
where the wanted rank should be, and counts exactly what lies below, between and above them
and what equals each; the part that holds the rank is the next range. Sketches and counts
merge within each task before anything is sent, so a group with a third of all rows is some
hundred numbers a task, and a row is compared with two splitters, whatever their number. A
splitter is a part of its own: values that very many rows share are settled at once, and
every round leaves fewer distinct values. What is left of a range once it has ``FEW`` rows is
put in order, by one task a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.session import stored

#: Shares that a sketch tells, and the rows that are put in order in a group; neither bears on the result.
BINS, FEW = 128, 4096
KEY = ("g", "k")


def _narrow(values: DataFrame, open_: DataFrame) -> DataFrame:
    """One round over ``g, k, low, high, rank, n``: the wanted rank, from 0, is among the n values from ``low`` to ``high``."""
    # Only groups of over FEW rows are open, so these tables are small beside the values.
    span = ["g", "low", "high"]

    def held(spans: DataFrame) -> DataFrame:
        return values.join(F.broadcast(spans), "g").where("v between low and high")

    cuts = F.percentile_approx("v", [i / BINS for i in range(BINS + 1)], 10 * BINS)
    sketches = held(open_.select(*span).distinct()).groupBy(*span).agg(cuts.alias("cuts"))
    place = F.col("rank") * BINS / F.col("n")
    below, above = F.greatest(F.floor(place) - 1, F.lit(0)), F.least(F.ceil(place) + 1, F.lit(BINS))
    ends = [F.get("cuts", at.cast("int")).alias(name) for name, at in (("a", below), ("b", above))]
    places = stored(open_.join(sketches, span).select(*span, "k", "rank", *ends), "quantile-places")
    cut = [*span, "a", "b"]
    part = F.expr("case when v < a then 0 when v = a then 1 when v < b then 2 when v = b then 3 else 4 end")
    counts = held(places.select(*cut).distinct()).groupBy(*cut, part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    counts = counts.withColumn("_upto", F.sum("n").over(Window.partitionBy(*cut).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    found = places.join(counts, cut).where("rank < _upto and rank >= _upto - n")
    return found.select(*KEY, F.col("least").alias("low"), F.col("most").alias("high"), (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"), "n")


def order_statistics(values: DataFrame, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """``g, k, v``: the value at place k, from 0, of each group's order; ``values`` is ``g, v``, ``ranks`` is ``g, k`` with each group's ``low, high, n``."""
    open_, settled = ranks.select(*KEY, "low", "high", F.col("k").alias("rank"), "n"), []
    while True:
        settled.append(open_.where(f"n <= {few} or low = high"))
        open_ = open_.where(f"n > {few} and low < high")
        if open_.isEmpty():
            break
        open_ = stored(_narrow(values, open_), "quantile-round")
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    single = done.where("low = high").select(*KEY, F.col("low").alias("v"))
    counts = values.join(done.where("low < high").drop("n"), "g").where("v between low and high").groupBy(*KEY, "rank", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*KEY).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return single.unionByName(counts.withColumn("_upto", upto).where("_upto > rank and _upto - c <= rank").select(*KEY, "v"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """``by, q, v``: the linear quantiles of each group, a row for each share.

    Nulls are left out and a group of nulls has no rows; NaN is greater than all. Null keys are
    a group. No rows give none.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_all"), *by).alias("g"), F.col(value).cast("double").alias("v"))
    values = stored(rows, "quantiles")
    wanted = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = wanted.withColumn("q", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("place", F.col("q") * (F.col("n") - 1))
    wanted = stored(wanted.withColumns({"below": F.floor("place"), "above": F.ceil("place")}), "quantile-places")
    ranks = wanted.select("g", "low", "high", "n", F.explode(F.array("below", "above")).alias("k")).distinct()
    found = order_statistics(values, ranks, few)
    out = wanted.select("g", "q", "place", "below", "above")
    out = out.join(found.select("g", F.col("k").alias("below"), F.col("v").alias("v0")), ["g", "below"])
    out = out.join(found.select("g", F.col("k").alias("above"), F.col("v").alias("v1")), ["g", "above"])
    part = F.col("place") - F.col("below")
    return out.select("g.*", "q", F.when(F.col("below") == F.col("above"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part).alias("v")).drop("_all")
