"""Prior specifications as INI text, compiled to columns.

Sections: ``variable_params`` names what is drawn, ``static_params`` what is fixed;
``prior-a+b`` gives a distribution of one or two of them, ``constraint-n`` a condition that draws
must meet, and ``waveform_transforms-a+b`` columns that follow from others.
"""

from __future__ import annotations

import configparser
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import astro as A
from quaver.functions.bounds import spin_components
from quaver.operators import counters
from quaver.operators.draws import sky_position, uniform_radius
from quaver.session import stored

#: Draws of a row under one counter, and how many a round tries.
EPOCH, TRIALS = 1024, 8


@dataclass(frozen=True)
class Spec:
    variables: tuple[str, ...]
    static: dict[str, str]
    #: (names, distribution, its options) in the order of the text.
    priors: tuple[tuple[tuple[str, ...], str, dict[str, str]], ...]
    constraints: tuple[str, ...]
    transforms: tuple[tuple[tuple[str, ...], str, dict[str, str]], ...] = field(default=())


def parsed(text: str) -> Spec:
    """A specification; a variable without a prior, or an unknown name, is an error."""
    ini = configparser.ConfigParser(allow_no_value=True, interpolation=None, delimiters=("=",))
    ini.optionxform = str
    ini.read_string(text)
    parts: dict[str, list] = {"prior": [], "constraint": [], "waveform_transforms": []}
    for section in ini.sections():
        kind, _, names = section.partition("-")
        if kind in parts:
            options = dict(ini[section])
            parts[kind].append((tuple(names.split("+")), options.pop("name"), options))
    variables = tuple(ini["variable_params"]) if ini.has_section("variable_params") else ()
    known = {n for names, _, _ in parts["prior"] for n in names}
    if missing := [v for v in variables if v not in known]:
        raise ValueError(f"no prior for {missing}")
    for kind, table in (("prior", DISTRIBUTIONS), ("waveform_transforms", TRANSFORMS)):
        if unknown := [name for _, name, _ in parts[kind] if name not in table]:
            raise ValueError(f"unknown {kind} {unknown}")
    static = dict(ini["static_params"]) if ini.has_section("static_params") else {}
    return Spec(variables, static, tuple(parts["prior"]), tuple(o["constraint_arg"] for _, _, o in parts["constraint"]), tuple(parts["waveform_transforms"]))


def read_spec(spark: SparkSession, path: str) -> Spec:
    """From a file that Spark can read."""
    return parsed(spark.read.text(path, wholetext=True).first()[0])


def _limits(names: tuple[str, ...], o: dict[str, str]) -> tuple[float, float]:
    return float(o[f"min-{names[0]}"]), float(o[f"max-{names[0]}"])


def _solid(names: tuple[str, ...], o: dict[str, str], u: list[Column]) -> dict[str, Column]:
    polar, azimuth = o.get("polar-angle", names[0]), o.get("azimuthal-angle", names[-1])
    return {polar: F.acos(1 - 2 * u[0]), azimuth: u[1] * (2 * math.pi)}


def _uniform(names: tuple[str, ...], o: dict[str, str], u: list[Column]) -> dict[str, Column]:
    low, high = _limits(names, o)
    return {names[0]: F.lit(low) + u[0] * (high - low)}


#: Distribution to columns of uniform draws.
DISTRIBUTIONS = {
    "uniform": _uniform,
    "uniform_angle": lambda n, o, u: {n[0]: u[0] * (2 * math.pi)},
    "sin_angle": lambda n, o, u: {n[0]: F.acos(1 - 2 * u[0])},
    "uniform_solidangle": _solid,
    "uniform_sky": lambda n, o, u: dict(zip(n, sky_position(*u[:2]))),
    "uniform_radius": lambda n, o, u: {n[0]: uniform_radius(u[0], *_limits(n, o))},
}


def _cartesian(names: tuple[str, ...], o: dict[str, str]) -> dict[str, Column]:
    return dict(zip((o["x"], o["y"], o["z"]), spin_components(F.col(o["radial"]), F.col(o["azimuthal"]), F.col(o["polar"]))))


TRANSFORMS = {
    "spherical_to_cartesian": _cartesian,
    "mass1_mass2_to_mchirp_q": lambda n, o: {"mchirp": A.chirp_mass(F.col("mass1"), F.col("mass2")), "q": F.col("mass1") / F.col("mass2")},
    "chirp_distance_to_distance": lambda n, o: {"distance": A.distance(F.col("chirp_distance"), F.col("mchirp"))},
}


def drawn(df: DataFrame, id_: str, spec: Spec, seed: int, trials: int = TRIALS) -> DataFrame:
    """Add ``trial`` and the variables of a specification to rows of distinct ids, and what its transforms give.

    A row takes its first draw that meets all constraints. A round tries some draws of every row that is
    left, side by side, and stores what it found; rounds go on until no row is left.
    """
    place = counters.draw(F.col(id_), seed, 0) * EPOCH + F.pmod(F.col("trial"), F.lit(EPOCH))
    left, found, first = df.select(id_), None, 0
    while True:
        trials = min(trials, EPOCH - first % EPOCH)
        tried = left.withColumn("trial", F.explode(F.sequence(F.lit(first), F.lit(first + trials - 1)))).withColumn("_place", place)
        columns: dict[str, Column] = {}
        for i, (names, kind, options) in enumerate(spec.priors):
            u = [counters.uniform(F.col("_place"), seed + first // EPOCH, stream=1 + 2 * i + j) for j in range(2)]
            columns |= DISTRIBUTIONS[kind](names, options, u)
        rows = tried.withColumns(columns)
        for condition in spec.constraints:
            rows = rows.where(F.expr(condition))
        taken = rows.groupBy(id_).agg(F.min_by(F.struct("trial", *columns), "trial").alias("_t")).select(id_, "_t.*")
        taken = stored(taken, "prior-draws")
        found = taken if found is None else found.unionByName(taken)
        left, first = left.join(taken.select(id_), id_, "left_anti"), first + trials
        if left.isEmpty():
            break
    for names, kind, options in spec.transforms:
        found = found.withColumns(TRANSFORMS[kind](names, options))
    return df.join(found, id_)
