"""Histograms, curves, weights, samples and splits over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.operators.counters import draw
from quaver.operators.ordered import bucketed, row_numbers, running_sums


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the greatest value, the last one closed."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column) - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def roc(scores: DataFrame) -> DataFrame:
    """``score, tpr, fpr`` for each distinct score of ``score, target``, descending."""
    by = scores.groupBy("score").agg(F.sum("target").cast("long").alias("p"), F.sum(1 - F.col("target")).cast("long").alias("q"))
    p, q = by.agg(F.sum("p"), F.sum("q")).first()
    rows = running_sums(bucketed(by, [F.desc("score")]), [F.desc("score")], {"tp": F.col("p"), "fp": F.col("q")})
    return rows.select("score", "p", "q", "tp", "fp", (F.col("tp") / F.lit(p or None)).alias("tpr"), (F.col("fp") / F.lit(q or None)).alias("fpr"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area by trapezoids, from exact integer sums."""
    rows = roc(scores)
    twice = F.sum((F.col("q") * (2 * F.col("tp") - F.col("p"))).cast("decimal(38,0)"))
    return rows.agg((twice / (2 * F.sum("p") * F.sum("q"))).cast("double").alias("auc"))


def rolling_mean(df: DataFrame, order: str, value: str, size: int, every: int) -> DataFrame:
    """Means of each row and the ``size - 1`` next, for every ``every``-th row.

    Rows are cut into runs of twenty sizes by their numbers; the first ``size - 1`` rows of a run go to the run before as well.
    """
    rows = row_numbers(bucketed(df, [F.col(order)]), [F.col(order)], "rn").select("rn", F.col(value).cast("decimal(28,6)").alias("v"))
    run = 20 * size
    own = F.expr(f"(rn - 1) div {run}")
    overlap = (F.pmod(F.col("rn") - 1, F.lit(run)) < size - 1) & (own > 0)
    spread = rows.select("rn", "v", own.alias("_own"), F.explode(F.when(overlap, F.array(own - 1, own)).otherwise(F.array(own))).alias("_run"))
    ahead = Window.partitionBy("_run").orderBy("rn").rowsBetween(0, size - 1)
    out = spread.select("rn", "_own", "_run", (F.sum("v").over(ahead).cast("double") / F.count("*").over(ahead)).alias("mean"))
    return out.where((F.col("_run") == F.col("_own")) & (F.pmod(F.col("rn") - 1, F.lit(every)) == 0)).select("rn", "mean")


def inverse_weights(df: DataFrame, column: str, width: float) -> DataFrame:
    """``bin, n, weight``: weights of bins that fall with their counts."""
    bins = df.groupBy(F.floor(F.col(column) / F.lit(width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = bins.agg(F.sum("n"), F.count("*")).first()
    return bins.select("bin", "n", (F.lit(float(total[0] or 0)) / (F.col("n") * F.lit(total[1] or 1))).alias("weight"))


def stratified_split(df: DataFrame, id_: str, stratum: str, share: float, seed: int = 42) -> DataFrame:
    """Mark the first ``share`` of each stratum, in order of a draw, as training rows.

    A stratum is never one task: rows are numbered along (stratum, hash, id) over ranges of
    that order, and each stratum's first number and count are joined back.
    """
    rows = df.select(id_, stratum, draw(F.col(id_), seed).alias("_h"))
    order = [F.col(stratum), F.col("_h"), F.col(id_)]
    rows = row_numbers(bucketed(rows, order), order, "_n")
    strata = rows.groupBy(F.col(stratum).alias("_s")).agg(F.min("_n").alias("_first"), F.count("*").alias("_all"))
    rows = rows.join(strata, F.col(stratum).eqNullSafe(F.col("_s")))
    return rows.select(id_, stratum, (F.col("_n") - F.col("_first") < F.floor(F.col("_all") * F.lit(share))).alias("training"))


def chunks(df: DataFrame, id_: str, n: int) -> DataFrame:
    """Near-equal consecutive chunks, the larger ones first."""
    rows = row_numbers(bucketed(df, [F.col(id_)]), [F.col(id_)], "rn")
    total = df.count()
    small, large = divmod(total, n)
    at, edge = F.col("rn") - 1, large * (small + 1)
    chunk = F.when(at < edge, F.expr(f"(rn - 1) div {small + 1}")).otherwise(F.lit(large) + F.expr(f"(rn - 1 - {edge}) div {max(small, 1)}"))
    return rows.select(id_, (chunk + 1).cast("int").alias("chunk"))


def histogram_of_edges(df: DataFrame, column: str, edges: int) -> DataFrame:
    """``bin, low, high, n`` between whole-number edges from the least to the greatest value, the last bin closed; empty bins and values past the last edge are left out."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.select(F.lit(0).alias("bin"), *[F.lit(0).cast("long").alias(c) for c in ("low", "high", "n")]).limit(0)
    at = [int((low + i * ((high - low) / (edges - 1))) // 1) for i in range(edges)]
    value, place = F.col(column), F.lit(None).cast("int")
    for i in reversed(range(edges - 1)):
        inside = (value >= at[i]) & ((value <= at[i + 1]) if i == edges - 2 else (value < at[i + 1]))
        place = F.when(inside, i).otherwise(place)
    counts = df.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    known = F.array(*[F.lit(x).cast("long") for x in at])
    return counts.select("bin", F.get(known, F.col("bin")).alias("low"), F.get(known, F.col("bin") + 1).alias("high"), "n")


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, with ``rn``; Spark cuts each task's groups to n rows before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)


def best_so_far(epochs: DataFrame, epoch: str, loss: str) -> DataFrame:
    """Add ``best``, the least loss up to each epoch, and ``improved``; one row an epoch, so one task orders them."""
    upto = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    improved = F.col(loss) < F.coalesce(F.min(loss).over(before), F.lit(float("inf")))
    return epochs.select(epoch, loss, F.min(loss).over(upto).alias("best"), improved.alias("improved"))


def sides(df: DataFrame, first: Column, second: Column, columns: list[str]) -> DataFrame:
    """The distinct rows of ``columns`` that only the first side has, the second, or ``both``; nulls are equal.

    Each task sends a distinct row once, with the sides it was seen on; no side is joined with another.
    """
    seen = df.where(first | second).groupBy(*columns).agg(F.bool_or(F.coalesce(first, F.lit(False))).alias("_a"), F.bool_or(F.coalesce(second, F.lit(False))).alias("_b"))
    return seen.select(*columns, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second").alias("side"))
