"""Ordered computations over whole tables, without a window in a single task.

A table is range-partitioned once by its whole order, ids that break ties included,
and stored with the number of each row's range. Windows run within the ranges in
parallel; what passes from range to range is one row a range, no more rows than
the session's shuffle partitions, and is broadcast. Ranges follow the data's
distribution, and a value that many rows share is cut by the columns after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.session import stored


def bucketed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df``, stored, with ``_bucket``, which rises along ``order``."""
    return stored(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()), "ordered")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running totals, the row itself included, to a bucketed table."""
    within = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy("_bucket").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    out = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_w_{k}") for k, v in sums.items()])
    out = out.join(F.broadcast(starts), "_bucket")
    return out.select(*df.columns, *[(F.col(f"_w_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums])


def row_numbers(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    return running_sums(df, order, {name: F.lit(1).cast("long")})


def numbered_within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 1 in an order that has no ties that matter; a group is never one task.

    Rows are numbered along group and order over ranges, and each group's first number is joined back.
    """
    along = [F.col(c) for c in (*by, *order)]
    rows = row_numbers(bucketed(df, along), along, "_rn")
    firsts = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.min("_rn").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    rows = rows.join(firsts, same)
    return rows.select(*df.columns, (F.col("_rn") - F.col("_first") + 1).alias(name))


def neighbours(df: DataFrame, order: list[Column], previous: dict[str, Column], following: dict[str, Column] | None = None) -> DataFrame:
    """Add to a bucketed table the last value that is not null before each row, and the first one after it.

    ``order`` rises. At the ends, where there is none, the values are null.
    """
    following = following or {}
    values = previous | following
    picks = {k: F.last for k in previous} | {k: F.first for k in following}
    frames = {k: (Window.unboundedPreceding, -1) for k in previous} | {k: (1, Window.unboundedFollowing) for k in following}
    place = F.struct(*order)
    ends = df.groupBy("_bucket").agg(
        *[(F.max_by if k in previous else F.min_by)(v, F.when(v.isNotNull(), place)).alias(f"_e_{k}") for k, v in values.items()]
    )
    over = Window.orderBy("_bucket")
    edges = ends.select("_bucket", *[picks[k](f"_e_{k}", ignorenulls=True).over(over.rowsBetween(*frames[k])).alias(f"_e_{k}") for k in values])
    # What follows is what came before in the reverse order: a frame that runs to the end is worked out anew for every row.
    upto = (Window.unboundedPreceding, -1)
    rising, falling = [Window.partitionBy("_bucket").orderBy(*o).rowsBetween(*upto) for o in (order, [c.desc() for c in order])]
    out = df.select("*", *[F.last(v, ignorenulls=True).over(rising if k in previous else falling).alias(f"_w_{k}") for k, v in values.items()])
    out = out.join(F.broadcast(edges), "_bucket")
    return out.select(*df.columns, *[F.coalesce(f"_w_{k}", f"_e_{k}").alias(k) for k in values])
