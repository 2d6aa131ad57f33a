"""Training samples: read by a manifest, paired over detectors, rescaled to a signal-to-noise ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions import astro as A
from quaver.operators import counters
from quaver.operators.ordered import bucketed, row_numbers


def gathered(manifest: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Add ``samples`` to manifest rows ``sample_id, det, seg, begin, n``: what stored blocks hold of that range.

    A row asks for the blocks that its range touches and no others, and they are put together by sample; a
    range beyond its series gives fewer samples, or an empty array.
    """
    wanted = manifest.where("n > 0").withColumn("block", F.explode(F.sequence(F.expr(f"begin div {size}"), F.expr(f"(begin + n - 1) div {size}"))))
    rows = wanted.join(blocks, ["det", "seg", "block"])
    first = F.greatest(F.lit(0), F.col("begin") - F.col("block") * size)
    last = F.least(F.size("samples"), F.col("begin") + F.col("n") - F.col("block") * size)
    part = F.slice("samples", (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    parts = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("block", part.alias("part")))).alias("_parts"))
    out = manifest.join(parts, "sample_id", "left")
    return out.select(*manifest.columns, F.coalesce(F.flatten("_parts.part"), F.array().cast("array<double>")).alias("samples"))


def repaired(rows: DataFrame, id_: str, batch: str, is_noise: Column, arrays: list[str], seed: int) -> DataFrame:
    """Deal the arrays of a batch's noise rows anew, each detector's by an order of its own; signals keep theirs.

    A batch is what is trained on at once, and so is one task's work. Adds ``<array>_from``, the id that each array came from.
    """
    noise = rows.where(is_noise).withColumn("_rank", F.row_number().over(Window.partitionBy(batch).orderBy(id_)))
    out = noise.select(*[c for c in rows.columns if c not in arrays], "_rank")
    for i, array in enumerate(arrays):
        place = F.row_number().over(Window.partitionBy(batch).orderBy(counters.draw(F.col(id_), seed, i), id_))
        out = out.join(noise.select(batch, place.alias("_rank"), F.col(id_).alias(f"{array}_from"), array), [batch, "_rank"])
    kept = rows.where(~is_noise).select("*", *[F.col(id_).alias(f"{a}_from") for a in arrays])
    return out.drop("_rank").unionByName(kept)


def cross_paired(rows: DataFrame, id_: str, is_signal: Column, first: str, second: str, seed: int, probability: float, with_signal: float) -> DataFrame:
    """Samples that no source in the sky makes: detectors that hold different things, labelled as noise.

    A coin picks noise rows to be replaced. A second coin takes a signal in the first detector and
    another signal in the second one, or else a signal in one of them, by a third coin, and this row's own noise in
    the other. Signals are drawn by number, with repeats; a pair never has one signal twice. Returns ``id, kind`` and, for
    each detector, the id that it comes from and its array. Without two signals no row is replaced by a pair of them.
    """
    order = [counters.draw(F.col(id_), seed, 9), F.col(id_)]
    numbered = row_numbers(bucketed(rows.where(is_signal).select(id_, first, second, order[0].alias("_o")), [F.col("_o"), F.col(id_)]), [F.col("_o"), F.col(id_)], "_number")
    n = numbered.count()
    if not n:
        return rows.limit(0).select(id_, F.lit("").alias("kind"), *[c for a in (first, second) for c in (F.col(id_).alias(f"{a}_from"), F.col(a))])
    key = F.col(id_)
    a = counters.whole(key, seed, n, 1)
    # Another one of the n - 1 others.
    b = F.pmod(a + 1 + counters.whole(key, seed, max(1, n - 1), 2), F.lit(n))
    kind = F.when(counters.coin(key, seed, with_signal, 3) & F.lit(n > 1), "both").when(counters.coin(key, seed, 0.5, 4), first).otherwise(second)
    picked = rows.where(~is_signal).where(counters.coin(key, seed, probability, 0)).select(id_, first, second, kind.alias("kind"), (a + 1).alias("_a"), (b + 1).alias("_b"))
    for side, number in ((first, "_a"), (second, "_b")):
        other = numbered.select(F.col("_number").alias(number), F.col(id_).alias(f"_{side}_id"), F.col(side).alias(f"_{side}"))
        picked = picked.join(other, number)
    columns = []
    for side in (first, second):
        taken = F.col("kind").isin("both", side)
        columns += [F.when(taken, F.col(f"_{side}_id")).otherwise(F.col(id_)).alias(f"{side}_from"), F.when(taken, F.col(f"_{side}")).otherwise(F.col(side)).alias(side)]
    return picked.select(id_, "kind", *columns)


#: Where a target ratio comes from: limits for ``uniform``, nothing for the others.
TARGETS = ("uniform", "half_normal", "plus_five", "fixed")


def target_snr(kind: str, own: Column, id_: Column, seed: int, low: float = 5.0, high: float = 15.0) -> Column:
    if kind == "uniform":
        return counters.uniform(id_, seed, low, high)
    if kind == "half_normal":
        return F.abs(counters.normal(id_, seed)) * 4 + 5
    return own + 5 if kind == "plus_five" else F.lit(low)


def rescaled(rows: DataFrame, arrays: list[str], own: Column, target: Column) -> DataFrame:
    """Signals scaled from their own ratio to a target; ``distance`` and ``dchirp`` follow, by the chirp mass ``mc``. A ratio of 0 or null leaves nulls."""
    factor = F.when(own > 0, target / own)
    out = rows.withColumns({"_f": factor, "snr": target}).withColumn("distance", F.col("distance") / F.col("_f"))
    out = out.withColumn("dchirp", A.chirp_distance(F.col("distance"), F.col("mc")))
    for array in arrays:
        out = out.withColumn(array, F.transform(array, lambda x: x * F.col("_f")))
    return out.drop("_f")


def moved(rows: DataFrame, arrays: list[str], dchirp: Column) -> DataFrame:
    """Signals at a new chirp distance: samples fall with the distance."""
    out = rows.withColumns({"dchirp": dchirp, "_old": F.col("distance")}).withColumn("distance", A.distance(F.col("dchirp"), F.col("mc")))
    for array in arrays:
        out = out.withColumn(array, F.transform(array, lambda x: x * F.col("_old") / F.col("distance")))
    return out.drop("_old")
