"""Priors over bounded mass regions, and rejection sampling until every row is accepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions import astro as A
from quaver.functions.bounds import Triangle
from quaver.operators import counters
from quaver.session import stored

#: Trials of a row in the first round, and trials under one counter.
TRIALS, EPOCH = 8, 1024


def bounded(df: DataFrame, id_: str, kind: str, triangle: Triangle, seed: int, limits: tuple[float, float] | None = None) -> DataFrame:
    """Add ``mass1, mass2, q, mchirp, tau`` under a prior of bounded masses.

    ``kind``: ``tau`` and ``mchirp`` are uniform in the duration or the chirp mass, ``power_tau`` and
    ``power_mchirp`` fall as a power law of exponent one half; then the first mass is uniform along the
    curve of that duration. ``limits`` narrows the chirp mass. ``mchirp_q`` is uniform in the chirp
    mass and in the mass ratio up to its bound.
    """
    u, v = (counters.uniform(F.col(id_), seed, stream=i) for i in (0, 1))
    share = u * u if kind.startswith("power") else u
    if kind.endswith("tau"):
        low, high = triangle.durations
        tau = F.lit(low) + share * F.lit(high - low)
    else:
        low, high = limits or triangle.chirp_masses
        mc = F.lit(low) + share * F.lit(high - low)
        tau = A.duration(mc, triangle.frequency)
    rows = df.select("*", tau.alias("tau"), v.alias("_v"))
    if kind == "mchirp_q":
        rows = rows.withColumn("mchirp", A.chirp_mass_of_duration(F.col("tau"), triangle.frequency))
        rows = rows.withColumn("q", 1 + F.col("_v") * (triangle.ratio_bound(F.col("mchirp")) - 1))
        m1, m2 = A.component_masses(F.col("mchirp"), F.col("q"))
        rows = rows.withColumns({"mass1": m1, "mass2": m2})
    else:
        entry, leave = triangle.first_mass_bounds(F.col("tau"))
        rows = rows.withColumn("mass1", entry + F.col("_v") * (leave - entry))
        rows = rows.withColumn("mass2", triangle.second_mass(F.col("tau"), F.col("mass1")))
        rows = rows.withColumns({"q": F.col("mass1") / F.col("mass2"), "mchirp": A.chirp_mass(F.col("mass1"), F.col("mass2"))})
    return rows.select(*df.columns, "mass1", "mass2", "q", "mchirp", "tau")


def trial(counter: Column, number: Column, seed: int, axis: int) -> Column:
    """A uniform draw of a row's trial: a row's own draw, then its trials count on from it."""
    place = counters.draw(counter, seed, 2) * F.lit(EPOCH) + F.pmod(number, F.lit(EPOCH))
    return counters.uniform(place, seed, stream=3 + axis)


def rejected_until_accepted(df: DataFrame, id_: str, low: list[float], high: list[float], accept: Callable[..., Column], seed: int, trials: int = TRIALS) -> DataFrame:
    """Add ``trial`` and ``point``, the first draw of a box that ``accept`` takes, for every row.

    A round tries the next ``trials`` draws of each row that is left, twice as many as the round before, and
    stores what it found; rounds go on until no row is left. Ids are not null; rows of one id draw alike.
    """
    left, found, first = df, None, 0
    while True:
        shift, trials = seed + first // EPOCH, min(trials, EPOCH - first % EPOCH)
        number = lambda i: i.cast("long") + F.lit(first)
        draws = F.transform(
            F.sequence(F.lit(0), F.lit(trials - 1)),
            lambda i: F.struct(number(i).alias("trial"), F.array(*[F.lit(a) + F.lit(b - a) * trial(F.col(id_), number(i), shift, k) for k, (a, b) in enumerate(zip(low, high))]).alias("point")),
        )
        taken = F.get(F.filter(draws, lambda d: accept(*[d["point"][k] for k in range(len(low))])), F.lit(0))
        tried = stored(left.withColumn("_taken", taken), "trials")
        kept = tried.where("_taken is not null").select(*df.columns, "_taken.trial", "_taken.point")
        found = kept if found is None else found.unionByName(kept)
        left, first, trials = tried.where("_taken is null").select(*df.columns), first + trials, min(2 * trials, EPOCH)
        if left.isEmpty():
            return found


def template_placement(df: DataFrame, id_: str, triangle: Triangle, seed: int) -> DataFrame:
    """Masses uniform in the chirp times, by rejection from the box that holds their region; about one draw in eight is taken."""
    m, n = triangle.high, triangle.low
    low, high = [triangle.tau0(m, m), triangle.tau3(m, m)], [triangle.tau0(n, n), triangle.tau3(n, n)]

    def inside(tau0: Column, tau3: Column) -> Column:
        least, greatest = triangle.tau3_bounds(tau0)
        return (tau3 >= least) & (tau3 <= greatest)

    rows = rejected_until_accepted(df, id_, low, high, inside, seed)
    m1, m2 = triangle.masses_of_chirp_times(F.col("point")[0], F.col("point")[1])
    return rows.select(*df.columns, "trial", F.col("point")[0].alias("tau0"), F.col("point")[1].alias("tau3"), m1.alias("mass1"), m2.alias("mass2"))
