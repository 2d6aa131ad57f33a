"""Recursive filters over batches of series: designs in second-order sections, zero-phase runs, decimation.

A batch is a matrix with a series a row; a step of the recursion goes over all rows at once.
"""

from __future__ import annotations

import numpy as np

#: Order, ripple in decibels and relative edge of the low-pass before a decimation; fixed values.
DECIMATION = (8, 0.05, 0.8)
#: A factor above this is decimated in stages, and no stage is above it.
LARGEST_STAGE = 13


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Rows ``b0 b1 b2 1 a1 a2``: conjugate poles together, what is real in pairs, a single one last; real zeros spread from both ends."""
    upper = sorted(poles[poles.imag > 1e-12], key=abs)
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    pairs = [(p, p.conjugate()) for p in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    left, rows = sorted(zeros.real), []
    for pair in sorted(pairs, key=len, reverse=True):
        mine = [left.pop(0), left.pop()] if len(pair) == 2 and len(left) > 1 else [left.pop()] if left else []
        b, a = np.real(np.poly(mine)) if mine else np.ones(1), np.real(np.poly(pair))
        rows.append(np.r_[b, np.zeros(3 - len(b)), a, np.zeros(3 - len(a))])
    out = np.array(rows)
    out[0, :3] *= gain
    return out


def _digital(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """The bilinear transform at two samples a second."""
    more = np.full(len(poles) - len(zeros), -1.0)
    gain *= np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    return _sections(np.r_[(4 + zeros) / (4 - zeros), more].astype(complex), (4 + poles) / (4 - poles), gain)


def _warped(edge: float, rate: float) -> float:
    if not 0 < edge < rate / 2:
        raise ValueError("an edge is above zero and below half the rate")
    return 4 * np.tan(np.pi * edge / rate)


def butterworth(order: int, rate: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Sections of a flat filter: band-pass between two edges, high-pass above ``low``, low-pass below ``high``."""
    at = np.exp(0.5j * np.pi * (2 * np.arange(order) + order + 1) / order)
    at[np.abs(at.imag) < 1e-12] = -1
    none = np.zeros(0)
    if low is None:
        edge = _warped(high, rate)
        return _digital(none, at * edge, edge**order)
    if high is None:
        return _digital(np.zeros(order), _warped(low, rate) / at, 1.0)
    a, b = _warped(low, rate), _warped(high, rate)
    half = at * (b - a) / 2
    apart = np.sqrt(half * half - a * b + 0j)
    return _digital(np.zeros(order), np.r_[half + apart, half - apart], (b - a) ** order)


def chebyshev(order: int, ripple: float, edge: float) -> np.ndarray:
    """Sections of a low-pass with ripples below its edge, as a share of half the rate."""
    e = np.sqrt(10 ** (ripple / 10) - 1)
    angle = np.pi * np.arange(1 - order, order, 2) / (2 * order)
    poles = -np.sinh(np.arcsinh(1 / e) / order + 1j * angle)
    gain = np.real(np.prod(-poles)) / (np.sqrt(1 + e * e) if order % 2 == 0 else 1)
    warped = _warped(edge, 2.0)
    return _digital(np.zeros(0), poles * warped, gain * warped**order)


def at_rest(sections: np.ndarray) -> np.ndarray:
    """States of the sections that have seen a constant one for ever."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        second = b2 - a2 * y
        out.append([level * (b1 - a1 * y + second), level * second])
        level *= y
    return np.array(out)


def run(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Each row through all sections, from states ``(sections, 2, rows)`` or from zero."""
    out = np.array(x, dtype=float).T.copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        z1, z2 = (np.zeros(out.shape[1]), np.zeros(out.shape[1])) if state is None else (state[i, 0].copy(), state[i, 1].copy())
        for t in range(len(out)):
            v = out[t].copy()
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out[t] = y
    return out.T


def padding(sections: np.ndarray, n: int) -> int:
    """Samples that are mirrored before and after a series; fewer than the series has."""
    taps = 2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())
    return int(min(3 * taps, max(n - 1, 0)))


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Forward and backward over each row, its ends mirrored around their last samples and the states at rest."""
    pad, n = padding(sections, x.shape[1]), x.shape[1]
    if not n:
        return x
    mirror = x[:, ::-1]
    out = np.hstack([2 * x[:, :1] - x[:, 1 : pad + 1][:, ::-1], x, 2 * x[:, -1:] - mirror[:, 1 : pad + 1]])
    rest = at_rest(sections)[:, :, None]
    for _ in range(2):
        out = run(sections, out, rest * out[:, 0])[:, ::-1]
    return out[:, pad : pad + n]


def prime_factors(n: int) -> list[int]:
    """Ascending, with repeats."""
    out, p = [], 2
    while n > 1:
        if p * p > n:
            p = n
        if n % p == 0:
            out.append(p)
            n //= p
        else:
            p += 1
    return out


def stages(factor: int) -> list[int]:
    """One stage, or the prime factors of a factor above ``LARGEST_STAGE``; a prime above it is an error."""
    if factor <= LARGEST_STAGE:
        return [factor]
    primes = prime_factors(factor)
    if max(primes) > LARGEST_STAGE:
        raise ValueError(f"{factor} has a prime factor above {LARGEST_STAGE}")
    return primes


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Every ``factor``-th sample after a zero-phase low-pass, in stages if need be."""
    order, ripple, edge = DECIMATION
    for q in stages(factor):
        if q > 1:
            x = zero_phase(x, chebyshev(order, ripple, edge / q))[:, ::q]
    return x
