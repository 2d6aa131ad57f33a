"""Antenna patterns, delays and projection of two polarisations onto detectors, as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Response tensors and places (metres) of the detectors, in the frame that turns with the Earth; fixed values.
RESPONSES = {
    "H1": ((-0.3926141, -0.0776130, -0.2473886), (-0.0776130, 0.3195244, 0.2279981), (-0.2473886, 0.2279981, 0.0730903)),
    "L1": ((0.4112809, 0.1402097, 0.2472943), (0.1402097, -0.1090056, -0.1816157), (0.2472943, -0.1816157, -0.3022755)),
}
PLACES = {"H1": (-2161414.92636, -3834695.17889, 4600350.22664), "L1": (-74276.0447238, -5496283.71971, 3224257.01744)}
LIGHT = 299792458.0
#: Sidereal turns: radians a second, and the angle at the start of counting, on 6 January 1980.
TURN, START = 2 * math.pi / 86164.0905, 1.7508


def sidereal_angle(seconds: Column) -> Column:
    return F.pmod(seconds * F.lit(TURN) + F.lit(START), F.lit(2 * math.pi))


def antenna(det: str, ra: Column, dec: Column, psi: Column, turned: Column) -> tuple[Column, Column]:
    """How strongly a detector takes the plus and the cross polarisation."""
    hour = turned - ra
    cp, sp, ch, sh, cd, sd = F.cos(psi), F.sin(psi), F.cos(hour), F.sin(hour), F.cos(dec), F.sin(dec)
    x = (-cp * sh - sp * ch * sd, -cp * ch + sp * sh * sd, sp * cd)
    y = (sp * sh - cp * ch * sd, sp * ch + cp * sh * sd, cp * cd)
    d = RESPONSES[det]
    pairs = [(i, j) for i in range(3) for j in range(3)]
    plus = sum((F.lit(d[i][j]) * (x[i] * x[j] - y[i] * y[j]) for i, j in pairs), F.lit(0.0))
    cross = sum((F.lit(d[i][j]) * (x[i] * y[j] + y[i] * x[j]) for i, j in pairs), F.lit(0.0))
    return plus, cross


def delay(det: str, ra: Column, dec: Column, turned: Column) -> Column:
    """Seconds by which a wave is later here than at the Earth's centre."""
    hour = turned - ra
    x, y, z = PLACES[det]
    return -(F.cos(dec) * F.cos(hour) * x - F.cos(dec) * F.sin(hour) * y + F.sin(dec) * z) / LIGHT


def projected(plus: Column, cross: Column, taken: tuple[Column, Column], shift: Column) -> Column:
    """The strain of two polarisations, so many samples later, around the end."""
    n = F.size(plus)
    return F.transform(plus, lambda _, i: F.get(plus, F.pmod(i - shift, n)) * taken[0] + F.get(cross, F.pmod(i - shift, n)) * taken[1])
