"""Small steps of curating samples and epochs: pairs, orders, cuts, paths and bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.operators import counters
from quaver.operators.ordered import bucketed, neighbours, row_numbers
from quaver.operators.quantiles import quantiles


def shuffled(df: DataFrame, id_: str, seed: int, name: str = "place") -> DataFrame:
    """Add each row's place, from 1, in a drawn order; another seed gives another order."""
    rows = bucketed(df.withColumn("_d", counters.draw(F.col(id_), seed)), [F.col("_d"), F.col(id_)])
    return row_numbers(rows, [F.col("_d"), F.col(id_)], name).select(*df.columns, name)


def with_noise(signals: DataFrame, noise: DataFrame, id_: str, arrays: list[str], seed: int) -> DataFrame:
    """Add a noise row's arrays to each signal's, sample by sample; noise is dealt in a drawn order, and again from its start if there is less of it. Adds ``noise_id``."""
    n = noise.count()
    if not n:
        return signals.limit(0).withColumn("noise_id", F.lit(None).cast("long"))
    left = shuffled(signals, id_, seed, "_p").withColumn("_r", F.pmod(F.col("_p") - 1, F.lit(n)) + 1)
    right = shuffled(noise, id_, seed + 1, "_r").select("_r", F.col(id_).alias("noise_id"), *[F.col(a).alias(f"_{a}") for a in arrays])
    rows = left.join(right, "_r")
    return rows.select(*[F.zip_with(c, f"_{c}", lambda x, y: x + y).alias(c) if c in arrays else F.col(c) for c in signals.columns], "noise_id")


def zero_filled(blocks: DataFrame, detectors: list[str]) -> DataFrame:
    """``seg, block`` with an array for each detector; one that has nothing there is zeros, as long as the longest that has."""
    rows = blocks.where(F.col("det").isin(detectors)).groupBy("seg", "block")
    rows = rows.agg(F.max(F.size("samples")).alias("_n"), *[F.first(F.when(F.col("det") == d, F.col("samples")), ignorenulls=True).alias(d) for d in detectors])
    return rows.select("seg", "block", *[F.coalesce(d, F.array_repeat(F.lit(0.0), F.col("_n"))).alias(d) for d in detectors])


def finite(array: Column) -> Column:
    """Whether an array has values and all of them are numbers."""
    return array.isNotNull() & (F.size(array) > 0) & F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x))


def below_percentile(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Rows whose value is not above their group's quantile."""
    cuts = quantiles(df, by, value, [share]).select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("v").alias("_cut"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    return df.join(cuts, same).where(F.col(value) <= F.col("_cut")).select(*df.columns)


def path_lengths(df: DataFrame, by: str, order: list[str], coordinates: list[str]) -> DataFrame:
    """``by, n, length``: summed distances of consecutive points of each group; one point has length 0."""
    along = [F.col(by), *[F.col(c) for c in order]]
    rows = neighbours(bucketed(df.select(by, *dict.fromkeys(order + coordinates)), along), along, {"_p": F.struct(by, *coordinates)})
    step = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_p.{c}"), F.lit(2.0)) for c in coordinates), F.lit(0.0)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col(by) == F.col(f"_p.{by}"), step)), F.lit(0.0)).alias("length"))


def bests_so_far(epochs: DataFrame, epoch: str, criteria: dict[str, str]) -> DataFrame:
    """For each criterion, ``min`` or ``max`` of a column, whether an epoch is better than all before it, and the best until then; one row an epoch."""
    before = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.col(epoch)]
    for name, way in criteria.items():
        best = (F.min if way == "min" else F.max)(name).over(before)
        better = best.isNull() | ((F.col(name) < best) if way == "min" else (F.col(name) > best))
        columns += [F.when(better, F.col(name)).otherwise(best).alias(f"best_{name}"), (better & F.col(name).isNotNull()).alias(f"improved_{name}")]
    return epochs.select(*columns)


def cross_entropy(score: Column, target: Column, weight: Column | float = 1.0) -> Column:
    """Weighted mean of the losses of raw scores against 0 and 1, in the form that does not overflow; null targets are left out."""
    loss = F.greatest(score, F.lit(0.0)) - score * target + F.log1p(F.exp(-F.abs(score)))
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    counted = F.when(target.isNotNull(), weight)
    return F.sum(counted * loss) / F.sum(counted)


def histograms(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """``parameter, bin, n`` of equal-width bins from each column's least to its greatest value, the last one closed, in one pass after the ranges."""
    ends = df.agg(*[f(c).cast("double").alias(f"{k}_{c}") for c in columns for k, f in (("low", F.min), ("high", F.max))]).first()
    cells = []
    for c in columns:
        low, high = ends[f"low_{c}"], ends[f"high_{c}"]
        if low is None:
            continue
        place = F.least(F.floor((F.col(c) - low) * F.lit(float(bins)) / F.lit(high - low)), F.lit(bins - 1)) if high > low else F.lit(0)
        cells.append(F.struct(F.lit(c).alias("parameter"), F.when(F.col(c).isNotNull(), place).cast("int").alias("bin")))
    if not cells:
        return df.select(F.lit("").alias("parameter"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    return df.select(F.inline(F.array(*cells))).where("bin is not null").groupBy("parameter", "bin").agg(F.count("*").alias("n"))
