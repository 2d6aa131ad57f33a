"""Queries of prior specifications, projections onto detectors, and steps of curation; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import arrays as V
from quaver.functions import astro as A
from quaver.functions import sky
from quaver.operators import counters as K
from quaver.operators import curation as C
from quaver.operators import draws, priors
from quaver.operators.tables import first_rows
from quaver.plans import draws as PD
from quaver.plans.training import _PAIRS, _ends, _pairs, _tell
from quaver.plans.vectors import _psd, _samples
from quaver.session import new_path, table
from quaver.sources import priors as S
from quaver.sources import roles as R

SEED, TRIALS, RATE = 71, 60, 2048.0
#: A specification as users write it.
SPEC = """
[variable_params]
mass1 =
mass2 =
ra =
dec =
inclination =
polarization =
chirp_distance =
spin1_a =
spin1_polar =
spin1_azimuthal =

[static_params]
f_lower = 20.0

[prior-mass1]
name = uniform
min-mass1 = 7.0
max-mass1 = 50.0

[prior-mass2]
name = uniform
min-mass2 = 7.0
max-mass2 = 50.0

[prior-ra+dec]
name = uniform_sky

[prior-inclination]
name = sin_angle

[prior-polarization]
name = uniform_angle

[prior-chirp_distance]
name = uniform_radius
min-chirp_distance = 130.0
max-chirp_distance = 350.0

[prior-spin1_a]
name = uniform
min-spin1_a = 0.0
max-spin1_a = 0.99

[prior-spin1_polar+spin1_azimuthal]
name = uniform_solidangle
polar-angle = spin1_polar
azimuthal-angle = spin1_azimuthal

[constraint-1]
name = custom
constraint_arg = mass2 <= mass1

[waveform_transforms-mchirp+q]
name = mass1_mass2_to_mchirp_q

[waveform_transforms-distance]
name = chirp_distance_to_distance

[waveform_transforms-spin1x+spin1y+spin1z]
name = spherical_to_cartesian
x = spin1x
y = spin1y
z = spin1z
radial = spin1_a
polar = spin1_polar
azimuthal = spin1_azimuthal
"""
SHOWN = ("mass1", "mass2", "ra", "dec", "inclination", "polarization", "chirp_distance", "mchirp", "q", "distance", "spin1x", "spin1y", "spin1z")
#: Bands of frequency bins, open at both ends, and all bins that are in one of them.
BANDS = ((1, 8), (8, 20), (20, 40), (40, 60))


def prior_spec_draws(spark, d):
    """Parameters of each injection by a specification that is written to a file and read again."""
    path = new_path(spark, "spec")
    spark.createDataFrame([(SPEC,)], "value string").coalesce(1).write.text(path)
    rows = S.drawn(R.injections(spark, d).select("inj_id"), "inj_id", S.read_spec(spark, path), SEED)
    return rows.select("inj_id", "trial", *[F.round(c, 6).alias(c) for c in SHOWN])


def _angles():
    key = F.col("vec_id")
    u = [K.uniform(key, SEED, stream=40 + i) for i in range(3)]
    ra, dec = draws.sky_position(u[0], u[1])
    return ra, dec, u[2] * 6.283185307179586, sky.sidereal_angle(F.lit(1238166018.0) + key * 97)


def sky_projection(spark, d):
    """Two polarisations, a vector's halves, onto both detectors: patterns, delays, and a sample of each strain."""
    ra, dec, psi, turned = _angles()
    rows = _pairs(spark, d).select("vec_id", "H1", "L1", ra.alias("ra"), dec.alias("dec"), psi.alias("psi"), turned.alias("turned"))
    at = [F.col(c) for c in ("ra", "dec", "psi", "turned")]
    for det in R.DETECTORS:
        plus, cross = sky.antenna(det, *at)
        rows = rows.withColumns({f"plus_{det}": plus, f"cross_{det}": cross, f"delay_{det}": sky.delay(det, at[0], at[1], at[3])})
    for det in R.DETECTORS:
        shift = F.round(F.col(f"delay_{det}") * RATE).cast("int")
        strain = sky.projected(F.col("H1"), F.col("L1"), (F.col(f"plus_{det}"), F.col(f"cross_{det}")), shift)
        rows = rows.withColumn(f"sample_{det}", F.get(strain, F.lit(5)))
    return rows.select("vec_id", *[F.round(f"{k}_{det}", 6).alias(f"{k}_{det}") for det in R.DETECTORS for k in ("plus", "cross", "delay", "sample")])


def signal_with_noise(spark, d):
    rows = _pairs(spark, d).select("vec_id", "target", "H1", "L1")
    out = C.with_noise(rows.where("target = 1"), rows.where("target = 0"), "vec_id", list(R.DETECTORS), SEED)
    return out.select("vec_id", "noise_id", *[F.round(c, 6).alias(n) for c, n in zip(_tell("H1", "L1"), ("h1_first", "h1_last", "l1_first", "l1_last"))])


def zero_filled_blocks(spark, d):
    """Both detectors' blocks, zeros where one has none; its segments of a third of the keys are left out first."""
    blocks = R.strain(spark, d).where("det = 'H1' or seg % 3 > 0")
    rows = C.zero_filled(blocks, list(R.DETECTORS))
    return rows.select("seg", "block", F.size("L1").alias("n"), *_tell("H1", "L1"))


def prior_modes(spark, d):
    """Each injection's masses under a prior that its epoch, a tenth of the ids, chooses: uniform in duration with a probability that falls from epoch to epoch, else another."""
    rows = R.injections(spark, d).select("inj_id", (F.col("inj_id") % 10).alias("epoch"))
    rows = rows.withColumn("p", draws.annealed(rows, "epoch", 2, 8, 0.9, 0.1))
    chosen = K.uniform(F.col("inj_id"), SEED, stream=50) < F.col("p")
    out = None
    for kind, condition in (("tau", chosen), ("mchirp_q", ~chosen)):
        part = priors.bounded(rows.where(condition).select("inj_id", "epoch"), "inj_id", kind, PD.TRIANGLE, PD.PRIOR_SEED)
        part = part.select("inj_id", "epoch", F.lit(kind).alias("kind"), F.round("mass1", 6).alias("mass1"), F.round("mass2", 6).alias("mass2"), F.when(F.col("mchirp") < 25, F.lit(0)).otherwise(1).alias("heavy"))
        out = part if out is None else out.unionByName(part)
    return out


def band_scores(spark, d):
    """The three greatest densities of each label in each of four bands and in all of them together."""
    rows = _psd(spark, d).where(C.finite(F.col("a")))
    scores = [V.trapezoid(V.bins_in(F.col("a"), (band,))) for band in BANDS]
    every = V.trapezoid(V.bins_in(F.col("a"), BANDS))
    listed = F.array(*[F.struct(F.lit(i).alias("band"), F.round(s, 6).alias("score")) for i, s in enumerate([*scores, every])])
    rows = rows.select("vec_id", "label", F.inline(listed))
    return first_rows(rows, ["label", "band"], [F.desc("score"), F.col("vec_id")], 3).select("label", "band", "rn", "vec_id", "score")


def loud_cut(spark, d):
    """Events of each kind that are not above its 90th percentile, over 8 and under 100, counted and summed."""
    rows = C.below_percentile(R.events(spark, d), ["event_type"], "stat", 0.9).where("stat > 8 and stat < 100")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("stat"), 2).alias("total"))


def daily_bests(spark, d):
    """Days as epochs: mean losses, and where each of four criteria is better than ever before."""
    days = R.events(spark, d).groupBy(F.expr(f"time div {86400 * R.SECOND}").alias("epoch")).agg(
        F.round(F.avg("stat"), 6).alias("loss"), F.round(F.avg(F.when(F.col("event_type") == "view", F.col("stat"))), 6).alias("validation"),
        F.count("*").alias("n"), F.round(F.avg((F.col("stat") > 30).cast("int")), 6).alias("accuracy"),
    )
    return C.bests_so_far(days, "epoch", {"loss": "min", "validation": "min", "n": "max", "accuracy": "max"})


def weighted_entropy(spark, d):
    rows = R.events(spark, d).select("event_type", ((F.col("stat") - 40) / 20).alias("x"), F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 2).cast("double")).alias("t"), (1 + F.col("event_id") % 3).cast("double").alias("w"))
    return rows.groupBy("event_type").agg(F.round(C.cross_entropy(F.col("x"), F.col("t"), F.col("w")), 6).alias("loss"))


QUERIES = {
    "prior_spec_draws": prior_spec_draws,
    "sky_projection": sky_projection,
    "signal_with_noise": signal_with_noise,
    "zero_filled_blocks": zero_filled_blocks,
    "prior_modes": prior_modes,
    "prior_histograms": lambda s, d: C.histograms(PD.priors(s, d), ["mass1", "mass2", "ra", "dec", "polarisation", "chirp_distance", "mchirp"], 50),
    "shuffled_rows": lambda s, d: C.shuffled(table(s, d, "orders").where("o_orderkey is not null").select("o_orderkey"), "o_orderkey", SEED),
    "band_scores": band_scores,
    "loud_cut": loud_cut,
    "path_lengths": lambda s, d: C.path_lengths(R.events(s, d).select("user_id", "event_id", (F.col("time") / (3600.0 * R.SECOND)).alias("hour"), "stat").where("user_id is not null"), "user_id", ["event_id"], ["hour", "stat"]).withColumn("length", F.round("length", 4)),
    "daily_bests": daily_bests,
    "weighted_entropy": weighted_entropy,
}


def _u(key: str, stream: int) -> str:
    return K.uniform_sql(key, SEED, stream)


def _spec_sql() -> str:
    spec, at = S.parsed(SPEC), {}
    for i, (names, _, _) in enumerate(spec.priors):
        at["+".join(names)] = [_u("place", 1 + 2 * i + j) for j in range(2)]
    u = {k: v[0] for k, v in at.items()}
    sky_, spin = at["ra+dec"], at["spin1_polar+spin1_azimuthal"]
    two_pi, ref = repr(6.283185307179586), A.REFERENCE_MASS / 2**0.2
    place = f"SELECT inj_id, t, {K.draw_sql('inj_id', SEED, 0)} * {S.EPOCH} + t AS place FROM inj, range({TRIALS}) r(t)"
    masses = f"SELECT *, 7 + 43 * {u['mass1']} AS mass1, 7 + 43 * {u['mass2']} AS mass2 FROM ({place})"
    first = f"SELECT inj_id, min(t) AS trial, arg_min(place, t) AS place, arg_min(mass1, t) AS mass1, arg_min(mass2, t) AS mass2 FROM ({masses}) WHERE mass2 <= mass1 GROUP BY inj_id"
    rest = f"""SELECT *, {sky_[0]} * {two_pi} AS ra, asin(2 * {sky_[1]} - 1) AS dec, acos(1 - 2 * {u['inclination']}) AS inclination, {u['polarization']} * {two_pi} AS polarization,
        pow({130.0**3} + {u['chirp_distance']} * {350.0**3 - 130.0**3}, 1.0::DOUBLE / 3) AS chirp_distance, 0.99 * {u['spin1_a']} AS sa, acos(1 - 2 * {spin[0]}) AS sp, {spin[1]} * {two_pi} AS sz FROM ({first})"""
    more = "SELECT *, pow(mass1 * mass2, 0.6) / pow(mass1 + mass2, 0.2) AS mchirp, mass1 / mass2 AS q, sa * sin(sp) * cos(sz) AS spin1x, sa * sin(sp) * sin(sz) AS spin1y, sa * cos(sp) AS spin1z FROM (" + rest + ")"
    far = f"SELECT *, chirp_distance * pow(mchirp / {ref!r}::DOUBLE, 5.0::DOUBLE / 6) AS distance FROM ({more})"
    return PD.P._sql("SELECT inj_id, trial, " + ", ".join(f"round({c}, 6) AS {c}" for c in SHOWN) + f" FROM ({far})")


def _sky_sql() -> str:
    parts = []
    for det in R.DETECTORS:
        m, (px, py, pz) = sky.RESPONSES[det], sky.PLACES[det]
        pairs = [(i, j) for i in range(3) for j in range(3)]
        plus = " + ".join(f"{m[i][j]} * (x{i} * x{j} - y{i} * y{j})" for i, j in pairs)
        cross = " + ".join(f"{m[i][j]} * (x{i} * y{j} + y{i} * x{j})" for i, j in pairs)
        parts += [f"{plus} AS plus_{det}", f"{cross} AS cross_{det}", f"-(cos(dec) * cos(h) * {px} - cos(dec) * sin(h) * {py} + sin(dec) * {pz}) / {sky.LIGHT} AS delay_{det}"]
    turned = f"(1238166018.0::DOUBLE + vec_id * 97) * {sky.TURN!r}::DOUBLE + {sky.START}"
    angles = f"SELECT vec_id, h AS hp, l AS hc, {_u('vec_id', 40)} * 6.283185307179586 AS ra, asin(2 * {_u('vec_id', 41)} - 1) AS dec, {_u('vec_id', 42)} * 6.283185307179586 AS psi, {turned} AS tn FROM pr"
    axes = f"""SELECT *, -cos(psi) * sin(h) - sin(psi) * cos(h) * sin(dec) AS x0, -cos(psi) * cos(h) + sin(psi) * sin(h) * sin(dec) AS x1, sin(psi) * cos(dec) AS x2,
        sin(psi) * sin(h) - cos(psi) * cos(h) * sin(dec) AS y0, sin(psi) * cos(h) + cos(psi) * sin(h) * sin(dec) AS y1, cos(psi) * cos(dec) AS y2
        FROM (SELECT *, tn - floor(tn / 6.283185307179586) * 6.283185307179586 - ra AS h FROM ({angles}))"""
    out = ["vec_id"]
    for det in R.DETECTORS:
        k = f"(((5 - round(delay_{det} * {RATE})::INT) % 32 + 32) % 32 + 1)"
        out += [f'round({c}_{det}, 6) AS "{c}_{det}"' for c in ("plus", "cross", "delay")]
        out.append(f'round(hp[{k}] * plus_{det} + hc[{k}] * cross_{det}, 6) AS "sample_{det}"')
    return f"WITH {_PAIRS} SELECT {', '.join(out)} FROM (SELECT *, {', '.join(parts)} FROM ({axes}))"


def _modes_sql() -> str:
    chosen = f"{_u('inj_id', 50)} < CASE WHEN inj_id % 10 < 2 THEN 0.9 WHEN inj_id % 10 >= 8 THEN 0.1 ELSE 0.9 + (inj_id % 10 - 2) * (0.1 - 0.9) / 5 END"
    return f"SELECT inj_id, inj_id % 10 AS epoch, kind, mass1, mass2, CASE WHEN mchirp < 25 THEN 0 ELSE 1 END AS heavy FROM ({PD.ORACLES['bounded_priors']}) WHERE ({chosen} AND kind = 'tau') OR (NOT ({chosen}) AND kind = 'mchirp_q')"


def _band_sql() -> str:
    area = lambda x: f"(list_sum({x}) - ({x}[1] + {x}[len({x})]) / 2)"
    slices = [f"a[{a + 2} : {b}]" for a, b in BANDS]
    scores = ", ".join(area(x) for x in [*slices, "(" + " || ".join(slices) + ")"])
    return f"""WITH p AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * x) AS a FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT vec_id, label, unnest([0, 1, 2, 3, 4]) AS band, round(unnest([{scores}]), 6) AS score FROM p)
        SELECT label, band, rn::INT AS rn, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label, band ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 3"""


_BEST = """{f}(CASE WHEN {c} IS NOT NULL THEN {c} END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _bests_sql() -> str:
    out = []
    for c, f, way in (("loss", "min", "<"), ("validation", "min", "<"), ("n", "max", ">"), ("accuracy", "max", ">")):
        before = _BEST.format(f=f, c=c)
        out += [f"CASE WHEN {before} IS NULL OR {c} {way} {before} THEN {c} ELSE {before} END AS best_{c}", f"coalesce({c} IS NOT NULL AND ({before} IS NULL OR {c} {way} {before}), false) AS improved_{c}"]
    return PD.P._sql(
        f"""SELECT epoch, {', '.join(out)} FROM (SELECT time // {86400 * R.SECOND} AS epoch, round(avg(stat), 6) AS loss, round(avg(stat) FILTER (WHERE event_type = 'view'), 6) AS validation,
        count(*) AS n, round(avg((stat > 30)::INT), 6) AS accuracy FROM ev GROUP BY 1)"""
    )


def _histograms_sql() -> str:
    names = ["mass1", "mass2", "ra", "dec", "polarisation", "chirp_distance", "mchirp"]
    return f"""SELECT parameter, least(floor((v - lo) * 50.0::DOUBLE / (hi - lo)), 49)::INT AS bin, count(*) AS n FROM (
        SELECT *, min(v) OVER (PARTITION BY parameter) AS lo, max(v) OVER (PARTITION BY parameter) AS hi FROM (
        SELECT unnest({names}) AS parameter, unnest([{', '.join(names)}]) AS v FROM ({PD.ORACLES['priors_uniform']}))) GROUP BY 1, 2"""


ORACLES = {
    "prior_spec_draws": _spec_sql(),
    "sky_projection": _sky_sql(),
    "signal_with_noise": f"""WITH {_PAIRS}, s AS (SELECT *, (row_number() OVER (ORDER BY {K.draw_sql('vec_id', SEED)}, vec_id) - 1) % (SELECT count(*) FROM pr WHERE target = 0) AS r FROM pr WHERE target = 1),
        n AS (SELECT *, row_number() OVER (ORDER BY {K.draw_sql('vec_id', SEED + 1)}, vec_id) - 1 AS r FROM pr WHERE target = 0)
        SELECT s.vec_id, n.vec_id AS noise_id, round(s.h[1] + n.h[1], 6) AS h1_first, round(s.h[32] + n.h[32], 6) AS h1_last, round(s.l[1] + n.l[1], 6) AS l1_first, round(s.l[32] + n.l[32], 6) AS l1_last FROM s JOIN n USING (r)""",
    "zero_filled_blocks": f"""WITH {R.SQL}, {R.STRAIN}, b AS (SELECT det, seg, pos // {R.BLOCK} AS block, list(v ORDER BY pos) AS x FROM smp WHERE det = 'H1' OR seg % 3 > 0 GROUP BY ALL),
        k AS (SELECT seg, block, max(len(x)) AS n FROM b GROUP BY ALL), z AS (
        SELECT k.seg, k.block, n, coalesce(h.x, list_transform(range(n), lambda i: 0.0::DOUBLE)) AS h, coalesce(l.x, list_transform(range(n), lambda i: 0.0::DOUBLE)) AS l
        FROM k LEFT JOIN b h ON h.det = 'H1' AND h.seg = k.seg AND h.block = k.block LEFT JOIN b l ON l.det = 'L1' AND l.seg = k.seg AND l.block = k.block)
        SELECT seg, block, len(l)::INT AS n, {_ends('h', 'h1')}, {_ends('l', 'l1')} FROM z""",
    "prior_modes": PD.P._sql(_modes_sql()),
    "prior_histograms": _histograms_sql(),
    "shuffled_rows": f"SELECT o_orderkey, row_number() OVER (ORDER BY {K.draw_sql('o_orderkey', SEED)}, o_orderkey) AS place FROM orders WHERE o_orderkey IS NOT NULL",
    "band_scores": _band_sql(),
    "loud_cut": PD.P._sql("SELECT event_type, count(*) AS n, round(sum(stat), 2) AS total FROM ev JOIN (SELECT event_type, quantile_cont(stat, 0.9) AS cut FROM ev GROUP BY 1) USING (event_type) WHERE stat <= cut AND stat > 8 AND stat < 100 GROUP BY event_type"),
    "path_lengths": PD.P._sql(
        f"""SELECT user_id, count(*) AS n, round(coalesce(sum(sqrt(pow(hour - ph, 2) + pow(stat - ps, 2))), 0), 4) AS length FROM (
        SELECT *, lag(hour) OVER (PARTITION BY user_id ORDER BY event_id) AS ph, lag(stat) OVER (PARTITION BY user_id ORDER BY event_id) AS ps FROM (SELECT user_id, event_id, time / (3600.0::DOUBLE * {R.SECOND}) AS hour, stat FROM ev WHERE user_id IS NOT NULL)) GROUP BY user_id"""
    ),
    "daily_bests": _bests_sql(),
    "weighted_entropy": PD.P._sql(
        """SELECT event_type, round(sum(w * (greatest(x, 0) - x * t + ln(1 + exp(-abs(x))))) / sum(w), 6) AS loss FROM (
        SELECT event_type, (stat - 40) / 20 AS x, (event_id % 2)::DOUBLE AS t, (1 + event_id % 3)::DOUBLE AS w FROM ev WHERE event_id % 5 > 0) GROUP BY event_type"""
    ),
}
