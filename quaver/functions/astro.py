"""Column functions of compact binaries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
G, C, SUN = 6.67e-11, 3e8, 1.989e30
MTSUN = 4.92549102554e-06
REFERENCE_MASS = 1.4


def chirp_mass(m1: Column, m2: Column) -> Column:
    return F.pow(m1 * m2, F.lit(0.6)) / F.pow(m1 + m2, F.lit(0.2))


def duration(mc: Column, low_frequency: float = 20.0) -> Column:
    """Seconds from a low frequency to the merger."""
    scale = 5 * (8 * math.pi * low_frequency) ** (-8 / 3)
    return F.lit(scale) * F.pow(mc * F.lit(SUN * G / C**3), F.lit(-5 / 3))


def chirp_mass_of_duration(tau: Column, low_frequency: float = 20.0) -> Column:
    scale = 5 * (8 * math.pi * low_frequency) ** (-8 / 3)
    return F.pow(tau / F.lit(scale), F.lit(-3 / 5)) / F.lit(SUN * G / C**3)


def component_masses(mc: Column, q: Column) -> tuple[Column, Column]:
    m2 = mc * F.pow(1 + q, F.lit(0.2)) / F.pow(q, F.lit(0.6))
    return m2 * q, m2


def _reference() -> float:
    return REFERENCE_MASS / 2**0.2


def distance(chirp_distance: Column, mc: Column) -> Column:
    return chirp_distance * F.pow(mc / F.lit(_reference()), F.lit(5 / 6))


def chirp_distance(distance_: Column, mc: Column) -> Column:
    return distance_ * F.pow(F.lit(_reference()) / mc, F.lit(5 / 6))


def normalised(x: Column, low: float, high: float) -> Column:
    return (x - low) / (high - low)


def isco_frequency(m1: Column, m2: Column) -> Column:
    return 1 / (F.lit(6**1.5 * math.pi * MTSUN) * (m1 + m2))


def volume_to_distance(volume: Column) -> Column:
    return F.pow(volume * F.lit(3 / (4 * math.pi)), F.lit(1 / 3))


def parity_odd_power(x: Column, alpha: float, beta: float) -> Column:
    return beta * x + x * F.pow(F.abs(x), F.lit(alpha - 1))
