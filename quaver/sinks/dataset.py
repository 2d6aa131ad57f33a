"""A data set in shards with a lookup table, as a training run reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.operators import counters
from quaver.operators.ordered import numbered_within

#: Columns of the lookup table besides those that are asked for.
LOOKUP = ("id", "path", "row", "target")


def sharded(rows: DataFrame, id_: str, target: str, size: int, seed: int) -> DataFrame:
    """Add ``shard`` and ``row``: each class in a drawn order, ``size`` rows a shard, the last one shorter."""
    drawn = rows.withColumn("_d", counters.draw(F.col(id_), seed))
    placed = numbered_within(drawn, [target], ["_d", id_], "_n")
    return placed.select(*rows.columns, F.expr(f"(_n - 1) div {size}").alias("shard"), F.expr(f"(_n - 1) % {size}").alias("row"))


def write_dataset(rows: DataFrame, path: str, id_: str, target: str, size: int, seed: int, keep: tuple[str, ...] = ()) -> None:
    """Shards below ``path``/data, a folder for each class and shard, and the lookup table in ``path``/lookup.

    A shard is one sorted run of rows, written by one task as one file; rows are shuffled once, by shard.
    """
    placed = sharded(rows, id_, target, size, seed).withColumn("class", F.col(target))
    data = placed.repartitionByRange("class", "shard", "row").sortWithinPartitions("class", "shard", "row")
    data.write.mode("errorifexists").partitionBy("class", "shard").parquet(f"{path}/data")
    where = F.concat(F.lit("class="), F.col("class"), F.lit("/shard="), F.col("shard"))
    lookup = placed.select(F.col(id_).alias("id"), where.alias("path"), "row", F.col(target).alias("target"), *keep)
    lookup.write.mode("errorifexists").parquet(f"{path}/lookup")
