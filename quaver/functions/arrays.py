"""Array columns as detector samples, with built-in functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def normalise(a: Column) -> Column:
    """To 0..1 by least and greatest, then around the mean; constants become zeros."""
    low, span = F.array_min(a), F.array_max(a) - F.array_min(a)
    scaled = F.transform(a, lambda x: F.when(span > 0, (x - low) / span).otherwise(0.0))
    mean = F.when(span > 0, (_sum(a) / F.size(a) - low) / span).otherwise(0.0)
    return F.transform(scaled, lambda x: x - mean)


def crop(a: Column, left: int, right: int) -> Column:
    return F.slice(a, left + 1, F.greatest(F.lit(0), F.size(a) - left - right))


def cyclic_shift(a: Column, k: int) -> Column:
    """Move each sample k places on, around the end."""
    n = F.size(a)
    by = F.pmod(F.lit(k), n)
    return F.concat(F.slice(a, n - by + 1, by), F.slice(a, F.lit(1), n - by))


def zero_pad(a: Column, before: int, total: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), before), a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(total - before) - F.size(a))))


def sinusoid(frequency: Column, phase: Column, n: int, rate: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(F.lit(2 * math.pi / rate) * frequency * i + phase))


def blackout(a: Column, median: Column, ratio: float, value: float = 999_999_999_999.0) -> Column:
    """Bins above ``ratio`` medians are set to a value that mutes them."""
    return F.zip_with(a, median, lambda x, m: F.when(x > m * ratio, value).otherwise(x))


def trapezoid(a: Column, step: float = 1.0) -> Column:
    """The area under values at equal steps; null of none."""
    return (_sum(a) - (F.get(a, F.lit(0)) + F.get(a, F.size(a) - 1)) / 2) * step


def band_integral(a: Column, first: int, last: int, step: float) -> Column:
    """Trapezoids over the bins first to last."""
    return trapezoid(F.slice(a, first + 1, last - first + 1), step)


def bins_in(a: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """The bins inside of bands, which are open at both ends, one band after another."""
    return F.concat(*[F.slice(a, low + 2, high - low - 1) for low, high in bands])


def per_position(df: DataFrame, array: str) -> DataFrame:
    """``group`` columns and ``pos, v`` of each element."""
    return df.select(*[c for c in df.columns if c != array], F.posexplode(array).alias("pos", "v"))
