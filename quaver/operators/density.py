"""Kernel density over a bounded range: rows add their kernels to a grid within each task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values whose kernels are added at once; bounds a task's memory at so many times the grid.
SLICE = 2048


def bounded_density(df: DataFrame, value: str, grid: list[float], low: float | None = None, high: float | None = None, bandwidth: float | None = None) -> DataFrame:
    """``x, density`` at each place of a grid: Gaussian kernels, with their reflections at the bounds that are given.

    The bandwidth is, unless given, the standard deviation times n to the power -1/5. Outside the bounds the density is 0. Null
    and non-finite values are left out; of fewer than two values, or equal ones, there is no bandwidth and the density is null.
    Each task keeps one grid of sums, so a grid a task is all that is sent.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null and abs(v) < double('infinity')")
    n, spread = rows.agg(F.count("*"), F.stddev_samp("v")).first()
    width = bandwidth or ((spread or 0.0) * n ** (-1 / 5) if n > 1 else 0.0)
    places = [p for p in enumerate(grid) if (low is None or p[1] >= low) and (high is None or p[1] <= high)]
    # The kernel of a reflected value at x is that of the value at x's reflection.
    seen = np.array([[x, *([2 * low - x] if low is not None else []), *([2 * high - x] if high is not None else [])] for _, x in places])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(places))
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                values = frame["v"].to_numpy()[at : at + SLICE]
                for side in range(seen.shape[1] if len(places) else 0):
                    sums += np.exp(-0.5 * ((seen[:, side, None] - values[None, :]) / width) ** 2).sum(axis=1)
        yield pd.DataFrame({"i": [i for i, _ in places], "s": sums})

    spark = df.sparkSession
    all_places = spark.createDataFrame([(i, float(x)) for i, x in enumerate(grid)], "i int, x double")
    if not width:
        return all_places.select("x", F.lit(None).cast("double").alias("density"))
    sums = rows.mapInPandas(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    scale = 1 / (n * width * math.sqrt(2 * math.pi))
    # The grid is a list on the driver already.
    return sums.join(F.broadcast(all_places), "i", "right").select("x", (F.coalesce("s", F.lit(0.0)) * F.lit(scale)).alias("density"))
