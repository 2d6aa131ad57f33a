"""Reproducible Gaussian noise of detectors: any slice, made anywhere, equals that slice of the whole series.

A sample is drawn by its detector, segment and position alone. Colour is a filter of so many
taps in time, so a block needs white samples a few taps beyond its borders, which its task
draws for itself: blocks are made without a shuffle and in any dealing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.operators import counters

#: Positions of a segment, in samples, are from minus half of this to half of it.
REACH = 1 << 32
SLICE = 256


def taps_of(amplitude: np.ndarray, n: int) -> np.ndarray:
    """A symmetric filter of an odd number of taps from an amplitude over the frequencies up to half the rate."""
    if n % 2 == 0:
        raise ValueError("an odd number of taps")
    return np.roll(np.fft.irfft(amplitude, 2 * (len(amplitude) - 1)), n // 2)[:n]


def noise(extents: DataFrame, size: int, seed: int, taps: dict[str, np.ndarray], scale: float = 1.0) -> DataFrame:
    """``det, seg, block, samples`` of ``det, seg, start, n`` extents in samples, in blocks from ``start`` on.

    ``taps`` has a detector's filter, one tap of 1 for white noise, and gives detectors their numbers; others have no noise.
    """
    kinds = {det: (i, np.asarray(t, float)) for i, (det, t) in enumerate(taps.items())}
    rows = extents.where(F.col("det").isin(list(kinds)) & (F.col("n") > 0))
    rows = rows.select("det", "seg", "start", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {size}"))).alias("block"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for det, own in frame.groupby("det"):
                stream, taps_ = kinds[det]
                half = len(taps_) // 2
                for at in range(0, len(own), SLICE):
                    some = own.iloc[at : at + SLICE]
                    first = some["start"].to_numpy() + some["block"].to_numpy() * size - half
                    place = first[:, None] + np.arange(size + 2 * half)
                    white = counters.normals(some["seg"].to_numpy()[:, None] * REACH + place, seed, stream)
                    out = sum(t * white[:, j : j + size] for j, t in enumerate(taps_[::-1])) * scale
                    left = np.minimum(size, some["n"].to_numpy() - some["block"].to_numpy() * size)
                    yield some[["det", "seg", "block"]].assign(samples=[row[:k] for row, k in zip(out, left)])

    return rows.mapInPandas(make, "det string, seg long, block long, samples array<double>")
