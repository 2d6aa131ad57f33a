"""Independent random draws as columns of a counter: the same row draws the same value however rows are dealt.

A counter of 64 bits, such as a row's id or a sample's position, goes through a keyed
bijection: multiply one half, xor the product's upper half, a round key and the other
half, and swap, ``ROUNDS`` times. Two counters never share an image under one key, and
each (seed, stream) has keys of its own. Products of 32 and 31 bits fit a long, so any
SQL engine can compute the same values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPLIER, ROUNDS, MASK = 0x53A5F2C9, 8, (1 << 32) - 1
#: Draws are whole numbers below this, exact as doubles.
RANGE = 1 << 53


def round_keys(seed: int, stream: int = 0) -> list[int]:
    """Keys of 32 bits, from a 64-bit scrambling of (seed, stream, round)."""
    keys, wide = [], (1 << 64) - 1
    for r in range(ROUNDS):
        x = seed & wide
        for word in (stream, r):
            x = (x ^ (word * 0x9E3779B97F4A7C15) ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & wide
            x = (x ^ (x >> 32)) * 0x94D049BB133111EB & wide
        keys.append((x ^ (x >> 31)) >> 32)
    return keys


def draw(counter: Column, seed: int, stream: int = 0) -> Column:
    """A whole number from 0 to ``RANGE - 1``; null for a null counter."""
    c = counter.cast("long")
    # Both halves in one long, the one that is multiplied next above the other.
    state = F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32))

    def turn(s: Column, key: Column) -> Column:
        product = F.shiftrightunsigned(s, 32) * F.lit(MULTIPLIER)
        mixed = F.shiftright(product, 32).bitwiseXOR(key).bitwiseXOR(s.bitwiseAND(F.lit(MASK)))
        return F.shiftleft(mixed, 32).bitwiseOR(product.bitwiseAND(F.lit(MASK)))

    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed, stream)])
    return F.aggregate(keys, state, turn, lambda s: F.shiftrightunsigned(s, 11))


def draws(counter: np.ndarray, seed: int, stream: int = 0) -> np.ndarray:
    """The same whole numbers of an array of counters, within a task."""
    c = counter.astype(np.int64).view(np.uint64)
    x, y = c & np.uint64(MASK), c >> np.uint64(32)
    for key in round_keys(seed, stream):
        product = x * np.uint64(MULTIPLIER)
        x, y = product >> np.uint64(32) ^ np.uint64(key) ^ y, product & np.uint64(MASK)
    return (x << np.uint64(21)) + (y >> np.uint64(11))


def normals(counter: np.ndarray, seed: int, stream: int = 0) -> np.ndarray:
    u, v = (draws(counter, seed, 2 * stream + i) / float(RANGE) for i in (0, 1))
    return np.sqrt(-2 * np.log(1 - u)) * np.cos(v * 2 * math.pi)


def draw_sql(counter: str, seed: int, stream: int = 0) -> str:
    """The same whole number in SQL."""
    start = f"[{counter} & {MASK}, ({counter} >> 32) & {MASK}]"
    keys = ", ".join(f"[{k}::BIGINT, 0]" for k in round_keys(seed, stream))
    turn = f"lambda s, k: [xor(xor((s[1] * {MULTIPLIER}) >> 32, k[1]), s[2]), (s[1] * {MULTIPLIER}) & {MASK}]"
    return f"(list_transform([list_reduce([{start}, {keys}], {turn})], lambda s: s[1] * {1 << 21} + (s[2] >> 11))[1])"


def uniform(counter: Column, seed: int, low: float = 0.0, high: float = 1.0, stream: int = 0) -> Column:
    return F.lit(low) + F.lit(high - low) * (draw(counter, seed, stream) / F.lit(float(RANGE)))


def uniform_sql(counter: str, seed: int, stream: int = 0) -> str:
    return f"({draw_sql(counter, seed, stream)} / {RANGE}.0::DOUBLE)"


def normal(counter: Column, seed: int, stream: int = 0) -> Column:
    """A standard normal draw, from two uniform draws of streams 2s and 2s + 1."""
    u, v = (uniform(counter, seed, stream=2 * stream + i) for i in (0, 1))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(v * F.lit(2 * math.pi))


def normal_sql(counter: str, seed: int, stream: int = 0) -> str:
    u, v = (uniform_sql(counter, seed, 2 * stream + i) for i in (0, 1))
    return f"(sqrt(-2 * ln(1 - {u})) * cos({v} * {2 * math.pi}))"


def coin(counter: Column, seed: int, probability: float, stream: int = 0) -> Column:
    """True with a probability."""
    return draw(counter, seed, stream) < F.lit(round(probability * RANGE))


def whole(counter: Column, seed: int, n: int | Column, stream: int = 0) -> Column:
    """A whole number from 0 to n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(counter, seed, stream=stream) * n).cast("long")
