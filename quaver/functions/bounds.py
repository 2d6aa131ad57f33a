"""Bounds of prior regions in masses, chirp mass, duration and chirp times, as column functions.

All masses lie between ``low`` and ``high``, the first one the greater. A curve of constant
duration enters that triangle at equal masses and leaves it where one mass is at its bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver.functions import astro as A


def cubic_root(c: Column, m: Column) -> Column:
    """The positive root of ``c x^3 - x - m`` for positive c and m; there is one."""

    def root(s: Column) -> Column:
        p, q = s["p"], s["q"]
        beyond = q * q - p * p * p
        u = F.cbrt(q + F.sqrt(F.greatest(beyond, F.lit(0.0))))
        return F.when(beyond >= 0, u + p / u).otherwise(2 * F.sqrt(p) * F.cos(F.acos(F.least(F.lit(1.0), q / F.pow(p, F.lit(1.5)))) / 3))

    # What c and m are made of is worked out once.
    given = F.struct(c.alias("c"), m.alias("m"))
    halves = F.transform(F.array(given), lambda s: F.struct((1 / (3 * s["c"])).alias("p"), (s["m"] / (2 * s["c"])).alias("q")))
    return F.get(F.transform(halves, root), F.lit(0))


def other_mass(mc: Column, mass: Column) -> Column:
    """The mass that has a chirp mass together with another one."""
    a = F.pow(mc, F.lit(5.0)) / F.pow(mass, F.lit(3.0))
    return cubic_root(1 / a, mass)


def spin_components(size: Column, azimuth: Column, polar: Column) -> tuple[Column, Column, Column]:
    """x, y and z of a spin of a size and two angles."""
    return size * F.sin(polar) * F.cos(azimuth), size * F.sin(polar) * F.sin(azimuth), size * F.cos(polar)


@dataclass(frozen=True)
class Triangle:
    """Masses from ``low`` to ``high`` and the lowest frequency that is heard."""

    low: float = 7.0
    high: float = 50.0
    frequency: float = 20.0

    @property
    def scale(self) -> float:
        """Duration of a chirp mass of one, in the masses' unit."""
        return 5 * (8 * math.pi * self.frequency) ** (-8 / 3) * (A.SUN * A.G / A.C**3) ** (-5 / 3)

    @property
    def chirp_masses(self) -> tuple[float, float]:
        return self.low / 2**0.2, self.high / 2**0.2

    @property
    def durations(self) -> tuple[float, float]:
        least, greatest = self.chirp_masses
        return self.scale * greatest ** (-5 / 3), self.scale * least ** (-5 / 3)

    def normaliser_ranges(self, tc: tuple[float, float], chirp_distance: tuple[float, float], snr: tuple[float, float]) -> dict[str, tuple[float, float]]:
        """Least and greatest value of each parameter that is scaled to 0..1."""
        mc = self.chirp_masses
        reach = [d * (m * 2**0.2 / A.REFERENCE_MASS) ** (5 / 6) for d, m in zip(chirp_distance, mc)]
        return {"tc": tc, "mchirp": mc, "dist": tuple(reach), "dchirp": chirp_distance, "q": (1.0, self.high / self.low), "invq": (0.0, 1.0), "snr": snr}

    def second_mass(self, tau: Column, mass1: Column) -> Column:
        """The second mass of a first one and a duration."""
        return cubic_root(F.pow(tau * mass1 / F.lit(self.scale), F.lit(3.0)), mass1)

    def first_mass_bounds(self, tau: Column) -> tuple[Column, Column]:
        """Where a curve of constant duration enters and leaves the triangle."""
        equal = F.pow(tau / F.lit(self.scale * 2 ** (1 / 3)), F.lit(-0.6))
        at_high, at_low = self.second_mass(tau, F.lit(self.high)), self.second_mass(tau, F.lit(self.low))
        return equal, F.when(at_high < self.low, at_low).otherwise(F.lit(self.high))

    def ratio_bound(self, mc: Column) -> Column:
        """The greatest mass ratio of a chirp mass, where one mass is at its bound."""
        turn = (self.high * self.low) ** 0.6 / (self.high + self.low) ** 0.2
        low, high = F.lit(self.low), F.lit(self.high)
        return F.when(mc > turn, high / other_mass(mc, high)).when(mc < turn, other_mass(mc, low) / low).otherwise(F.lit(self.high / self.low))

    @property
    def chirp_scales(self) -> tuple[float, float]:
        """What tau0 and tau3 are multiples of."""
        f = math.pi * self.frequency
        return 5 / (256 * f ** (8 / 3)), math.pi / (8 * f ** (5 / 3))

    def tau0(self, m1: float | Column, m2: float | Column) -> float | Column:
        return self.chirp_scales[0] * ((m1 + m2) * A.MTSUN) ** (-5 / 3) * (m1 + m2) ** 2 / (m1 * m2)

    def tau3(self, m1: float | Column, m2: float | Column) -> float | Column:
        return self.chirp_scales[1] * ((m1 + m2) * A.MTSUN) ** (-2 / 3) * (m1 + m2) ** 2 / (m1 * m2)

    def chirp_mass_of_tau0(self, tau0: Column) -> Column:
        return F.pow(F.lit(self.chirp_scales[0]) / tau0, F.lit(0.6)) / A.MTSUN

    def tau3_bounds(self, tau0: Column) -> tuple[Column, Column]:
        """Least and greatest tau3 of a tau0: equal masses, and one mass at its bound."""
        a0, a3 = self.chirp_scales
        mc, turn = self.chirp_mass_of_tau0(tau0), self.tau0(self.high, self.low)
        low, high = F.lit(self.low), F.lit(self.high)
        least = 4 * a3 * F.pow(tau0 / F.lit(4 * a0), F.lit(0.4))
        return least, F.when(tau0 > turn, self._tau3(other_mass(mc, low), low)).otherwise(self._tau3(high, other_mass(mc, high)))

    def _tau3(self, m1: Column, m2: Column) -> Column:
        return F.lit(self.chirp_scales[1]) * F.pow((m1 + m2) * A.MTSUN, F.lit(-2 / 3)) * (m1 + m2) * (m1 + m2) / (m1 * m2)

    def masses_of_chirp_times(self, tau0: Column, tau3: Column) -> tuple[Column, Column]:
        a0, a3 = self.chirp_scales
        total = (tau3 / F.lit(a3)) / (tau0 / F.lit(a0))
        eta = F.pow(total, F.lit(-2 / 3)) * F.lit(a3) / tau3
        apart = F.sqrt(F.greatest(F.lit(0.0), 1 - 4 * eta))
        return total / (2 * A.MTSUN) * (1 + apart), total / (2 * A.MTSUN) * (1 - apart)
