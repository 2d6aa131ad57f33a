"""Bins of several rates over a signal: their plan, their lengths, and sampling by them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from quaver.functions.astro import MTSUN
from quaver.functions.filters import decimate

#: Rate of pure noise, and the frequencies that stand for merger and noise; fixed values.
NOISE_RATE, MERGER, NOISE = 64.0, 750.0, 50.0


@dataclass(frozen=True)
class Plan:
    """What the bins depend on: seconds, hertz and solar masses."""

    seconds: float = 20.0
    rate: float = 2048.0
    low_frequency: float = 20.0
    low_mass: float = 7.0
    merger_from: float = 18.0
    merger_to: float = 18.2
    ringdown: float = 0.15
    after_merger: float = 0.15
    start_factor: float = 4.0
    rate_factor: float = 2.0
    band_factor: float = 2.0

    @property
    def samples(self) -> int:
        return int(self.seconds * self.rate)


def frequencies(plan: Plan) -> tuple[np.ndarray, np.ndarray, float]:
    """By time before the merger, reversed: times, the greatest frequency that is heard then, and the one at the merger."""
    last = 1 / (6**1.5 * math.pi * MTSUN * 2 * plan.low_mass)
    offset = plan.seconds - plan.merger_from
    t = np.linspace(-offset, plan.seconds - offset, plan.samples)
    merger = ((t < 0) & (t >= -(plan.merger_to - plan.merger_from + plan.ringdown))) | ((t >= 0) & (t < plan.after_merger))
    inspiral = (t > 0) & (t > plan.after_merger) & ~merger
    f = np.where(merger, MERGER, NOISE)
    f[inspiral] = np.minimum(last, plan.low_frequency / (t[inspiral] / 20.0) ** 0.375)
    return t, f, last


def bins(plan: Plan) -> list[tuple[int, int, float]]:
    """``start, end, rate`` of each bin, in the order of the signal.

    Before the merger a bin ends where the frequency has fallen by ``band_factor``, until the lowest one; each has a
    rate lower by ``rate_factor``. The merger keeps the full rate and what follows it is noise.
    """
    if plan.start_factor < 2:
        raise ValueError("a rate is at least twice its frequency")
    _, f, last = frequencies(plan)
    edges = [0]
    merger = np.flatnonzero(f == MERGER)
    if len(merger):
        edges.append(int(merger[0]))
    inspiral = np.flatnonzero((f < MERGER) & (f > last / 2))
    if len(inspiral):
        edges.append(int(inspiral[0]))
    taken, at, top = set(edges[1:]), 0, last
    while top >= plan.low_frequency:
        fallen = np.flatnonzero((f[at:] < top / plan.band_factor) & (f[at:] != NOISE))
        fallen = [int(at + i) for i in fallen[:3] if at + i not in taken]
        if not fallen:
            break
        edges.append(fallen[0])
        at, top = fallen[0] + 1, top / plan.band_factor
    edges = [*sorted(edges), len(f)]
    rates = [NOISE_RATE, plan.rate] + [last * plan.start_factor / plan.rate_factor**i for i in range(max(0, len(edges) - 3))]
    # Time ran back from the signal's end.
    return sorted((plan.samples - b, plan.samples - a, r) for a, b, r in zip(edges, edges[1:], rates))


def _place(at: int, n: int, slow: int) -> int:
    return int(at / n * slow)


def sampled_length(parts: list[tuple[int, int, float]], n: int, rate: float, trim: tuple[int, int] = (0, 0)) -> int:
    """How many samples are left of n after ``sample``."""
    total = -sum(trim)
    for start, end, new in parts:
        slow = int(n / int(round(rate / new)))
        total += _place(end, n, slow) - _place(start, n, slow)
    return total


def sample(x: np.ndarray, parts: list[tuple[int, int, float]], rate: float, trim: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Rows decimated as a whole for each bin's rate, cut to the bin and joined; ``trim`` samples go at both ends, if both are above zero."""
    n, out, slow = x.shape[1], [], {}
    for start, end, new in parts:
        factor = int(round(rate / new))
        if new == rate:
            out.append(x[:, int(start) : int(end)])
            continue
        if factor not in slow:
            slow[factor] = decimate(x, factor)
        m = int(n / factor)
        out.append(slow[factor][:, _place(start, n, m) : _place(end, n, m)])
    joined = np.hstack(out)
    return joined[:, trim[0] : -trim[1]] if trim[0] and trim[1] else joined
