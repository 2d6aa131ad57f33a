"""Queries of draws, priors and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import astro as A
from quaver.functions.bounds import Triangle
from quaver.operators import counters as K
from quaver.operators import density
from quaver.operators import draws as W
from quaver.operators import priors as O
from quaver.plans import search as P
from quaver.sources import roles as R

START, END, FIRST, LAST = 3, 9, 0.2, 0.8
TRIANGLE, PRIOR_SEED = Triangle(), 21
KINDS = ("tau", "mchirp", "power_tau", "power_mchirp", "mchirp_q")
GRID, GRID_LOW, GRID_HIGH = [float(x) for x in range(-10, 330, 10)], 0.0, 300.0


def priors(spark, d):
    """Masses, sky, polarisation and chirp distance of each injection."""
    u = [K.uniform(F.col("inj_id"), k) for k in range(1, 7)]
    m1, m2 = W.ordered_masses(u[0], u[1], 7.0, 50.0)
    ra, dec = W.sky_position(u[2], u[3])
    columns = {"mass1": m1, "mass2": m2, "ra": ra, "dec": dec, "polarisation": u[4] * 6.283185307179586, "chirp_distance": W.uniform_radius(u[5], 130.0, 350.0), "mchirp": A.chirp_mass(m1, m2)}
    return R.injections(spark, d).select("inj_id", *[F.round(v, 6).alias(k) for k, v in columns.items()])


def annealed_probability(spark, d):
    """The probability of a mode on each day with events, and how many events it would pick; the first day is epoch 0."""
    days = R.events(spark, d).groupBy(F.expr(f"time div {86400 * R.SECOND}").alias("day")).agg(F.count("*").alias("n"))
    first = days.agg(F.min("day")).first()[0]
    epochs = days.select((F.col("day") - F.lit(first)).alias("epoch"), "n")
    p = W.annealed(epochs, "epoch", START, END, FIRST, LAST)
    return epochs.select("epoch", "n", F.round(p, 9).alias("p"), F.round(p * F.col("n"), 6).alias("picked"))


def bounded_priors(spark, d):
    """Masses of each injection under each bounded prior."""
    rows, out = R.injections(spark, d).select("inj_id"), None
    for kind in KINDS:
        drawn = O.bounded(rows, "inj_id", kind, TRIANGLE, PRIOR_SEED)
        drawn = drawn.select("inj_id", F.lit(kind).alias("kind"), *[F.round(c, 6).alias(c) for c in ("mass1", "mass2", "q", "mchirp", "tau")])
        out = drawn if out is None else out.unionByName(drawn)
    return out


def template_placement(spark, d):
    """Masses of each injection uniform in the chirp times, by rejection; with the trial that was taken."""
    rows = O.template_placement(R.injections(spark, d).select("inj_id"), "inj_id", TRIANGLE, PRIOR_SEED)
    return rows.select("inj_id", "trial", *[F.round(c, 6).alias(c) for c in ("tau0", "tau3", "mass1", "mass2")])


def bounded_density(spark, d):
    """Density of loudness on a grid, reflected at its bounds; the grid passes them on both sides."""
    rows = density.bounded_density(R.events(spark, d), "stat", GRID, GRID_LOW, GRID_HIGH)
    return rows.select("x", F.round("density", 9).alias("density"))


def segment_choice(spark, d):
    """For each injection a span of activity, likelier the longer it is, and a second within it."""
    spans = R.segments(spark, d, f"time div {1800 * R.SECOND}").select("seg_id", *[F.expr(f"{c} div {R.SECOND}").alias(c) for c in ("start", "end")])
    return W.by_duration(R.injections(spark, d).select("inj_id"), "inj_id", spans, PRIOR_SEED)


def score_losses(spark, d):
    """Sigmoid scores, masked errors, seeds and padded lengths, by kind of event."""
    rows = R.events(spark, d).select("event_type", "event_id", "stat", F.when(F.col("event_type") == "view", -1.0).otherwise(F.col("stat") / 500).alias("target"))
    p = W.sigmoid((F.col("stat") - 250) / 100)
    odd = A.parity_odd_power(p - 0.5, 3.0, 0.3)
    error = F.pow(p - F.col("target"), F.lit(2.0))
    return rows.groupBy("event_type").agg(
        F.round(F.avg(p), 6).alias("mean_score"),
        F.round(W.masked_mean(error, F.col("target")), 6).alias("masked_error"),
        F.round(F.avg(F.exp(0.5 - odd)), 6).alias("power_loss"),
        F.max(W.sample_seed(2, 1000, F.col("event_id"), 5)).alias("last_seed"),
        F.max(W.next_power_of_two(F.col("event_id") + 1)).alias("padded"),
    )


QUERIES = {"priors_uniform": priors, "annealed_probability": annealed_probability, "bounded_priors": bounded_priors, "template_placement": template_placement, "bounded_density": bounded_density, "segment_choice": segment_choice, "score_losses": score_losses}

_U = [K.uniform_sql("inj_id", k) for k in range(1, 7)]
_M1, _M2 = f"(7.0::DOUBLE + 43.0 * greatest({_U[0]}, {_U[1]}))", f"(7.0::DOUBLE + 43.0 * least({_U[0]}, {_U[1]}))"


def _cubic(c: str, m: str) -> str:
    p, q = f"(1 / (3 * ({c})))", f"(({m}) / (2 * ({c})))"
    beyond = f"({q} * {q} - {p} * {p} * {p})"
    u = f"cbrt({q} + sqrt(greatest({beyond}, 0)))"
    return f"(CASE WHEN {beyond} >= 0 THEN {u} + {p} / {u} ELSE 2 * sqrt({p}) * cos(acos(least(1.0, {q} / pow({p}, 1.5))) / 3) END)"


def _other(mc: str, mass: str) -> str:
    return _cubic(f"pow({mass}, 3.0) / pow({mc}, 5.0)", mass)


def _bounded_sql(kind: str) -> str:
    t = TRIANGLE
    (low, high), share = t.durations if kind.endswith("tau") else t.chirp_masses, "u * u" if kind.startswith("power") else "u"
    x = f"({low!r}::DOUBLE + {share} * {high - low!r}::DOUBLE)"
    tau = x if kind.endswith("tau") else f"{t.scale!r}::DOUBLE * pow({x}, -5.0::DOUBLE / 3)"
    second = lambda m: _cubic(f"pow(tau * {m} / {t.scale!r}::DOUBLE, 3.0)", m)
    draws = f"SELECT inj_id, {tau} AS tau, v FROM (SELECT inj_id, {K.uniform_sql('inj_id', PRIOR_SEED)} AS u, {K.uniform_sql('inj_id', PRIOR_SEED, 1)} AS v FROM inj)"
    if kind == "mchirp_q":
        turn = (t.high * t.low) ** 0.6 / (t.high + t.low) ** 0.2
        most = f"CASE WHEN mc > {turn!r} THEN {t.high} / {_other('mc', str(t.high))} ELSE {_other('mc', str(t.low))} / {t.low} END"
        rows = f"SELECT inj_id, tau, mc, 1 + v * ({most} - 1) AS q FROM (SELECT *, pow(tau / {t.scale!r}::DOUBLE, -0.6) AS mc FROM ({draws}))"
        rows = f"SELECT inj_id, tau, mc AS mchirp, q, mc * pow(1 + q, 0.2) / pow(q, 0.6) * q AS mass1, mc * pow(1 + q, 0.2) / pow(q, 0.6) AS mass2 FROM ({rows})"
    else:
        leave = f"CASE WHEN {second(str(t.high))} < {t.low} THEN {second(str(t.low))} ELSE {t.high} END"
        rows = f"SELECT *, pow(tau / {t.scale * 2 ** (1 / 3)!r}::DOUBLE, -0.6) AS entry, {leave} AS leave FROM ({draws})"
        rows = f"SELECT inj_id, tau, mass1, {second('mass1')} AS mass2 FROM (SELECT *, entry + v * (leave - entry) AS mass1 FROM ({rows}))"
        rows = f"SELECT *, mass1 / mass2 AS q, pow(mass1 * mass2, 0.6) / pow(mass1 + mass2, 0.2) AS mchirp FROM ({rows})"
    return f"SELECT inj_id, '{kind}' AS kind, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mass1", "mass2", "q", "mchirp", "tau")) + f" FROM ({rows})"


def _placement_sql(trials: int = 300) -> str:
    """The first of many trials that fits; that none does has a chance of 1e-18."""
    t = TRIANGLE
    (a0, a3), sun = t.chirp_scales, A.MTSUN
    box = [(t.tau0(t.high, t.high), t.tau0(t.low, t.low)), (t.tau3(t.high, t.high), t.tau3(t.low, t.low))]
    place = f"SELECT inj_id, t, {K.draw_sql('inj_id', PRIOR_SEED, 2)} * {O.EPOCH} + t AS place FROM inj, range({trials}) r(t)"
    point = f"SELECT *, {box[0][0]!r}::DOUBLE + {box[0][1] - box[0][0]!r}::DOUBLE * {K.uniform_sql('place', PRIOR_SEED, 3)} AS tau0, {box[1][0]!r}::DOUBLE + {box[1][1] - box[1][0]!r}::DOUBLE * {K.uniform_sql('place', PRIOR_SEED, 4)} AS tau3 FROM ({place})"
    tau3 = lambda m, n: f"{a3!r}::DOUBLE * pow(({m} + {n}) * {sun!r}::DOUBLE, -2.0::DOUBLE / 3) * ({m} + {n}) * ({m} + {n}) / ({m} * {n})"
    other = f"SELECT *, {_other('mc', str(t.low))} AS beside_low, {_other('mc', str(t.high))} AS beside_high FROM (SELECT *, pow({a0!r}::DOUBLE / tau0, 0.6) / {sun!r}::DOUBLE AS mc FROM ({point}))"
    fits = f"tau3 >= {4 * a3!r}::DOUBLE * pow(tau0 / {4 * a0!r}::DOUBLE, 0.4) AND tau3 <= CASE WHEN tau0 > {t.tau0(t.high, t.low)!r} THEN {tau3('beside_low', str(t.low))} ELSE {tau3(str(t.high), 'beside_high')} END"
    first = f"SELECT inj_id, min(t) AS trial, arg_min(tau0, t) AS tau0, arg_min(tau3, t) AS tau3 FROM ({other}) WHERE {fits} GROUP BY inj_id"
    masses = f"SELECT *, total / {2 * sun!r}::DOUBLE AS half, sqrt(greatest(0, 1 - 4 * pow(total, -2.0::DOUBLE / 3) * {a3!r}::DOUBLE / tau3)) AS apart FROM (SELECT *, (tau3 / {a3!r}::DOUBLE) / (tau0 / {a0!r}::DOUBLE) AS total FROM ({first}))"
    return f"SELECT inj_id, trial, round(tau0, 6) AS tau0, round(tau3, 6) AS tau3, round(half * (1 + apart), 6) AS mass1, round(half * (1 - apart), 6) AS mass2 FROM ({masses})"


ORACLES = {
    "priors_uniform": P._sql(
        f"""SELECT inj_id, round(mass1, 6) AS mass1, round(mass2, 6) AS mass2, round(ra, 6) AS ra, round(dec, 6) AS dec, round(polarisation, 6) AS polarisation,
        round(chirp_distance, 6) AS chirp_distance, round(pow(mass1 * mass2, 0.6) / pow(mass1 + mass2, 0.2), 6) AS mchirp
        FROM (SELECT inj_id, {_M1} AS mass1, {_M2} AS mass2, {_U[2]} * 2 * pi() AS ra, asin(2 * {_U[3]} - 1) AS dec, {_U[4]} * 2 * pi() AS polarisation,
        pow({130.0**3}::DOUBLE + {_U[5]} * {350.0**3 - 130.0**3}, 1.0::DOUBLE / 3) AS chirp_distance FROM inj)"""
    ),
    "annealed_probability": P._sql(
        f"""SELECT e AS epoch, n, round(p, 9) AS p, round(p * n, 6) AS picked FROM (
        SELECT e, n, CASE WHEN e < {START} THEN {FIRST} WHEN e >= {END} THEN {LAST} ELSE {FIRST} + (e - {START}) * ({LAST} - {FIRST}) / {END - START - 1} END::DOUBLE AS p
        FROM (SELECT day - min(day) OVER () AS e, n FROM (SELECT time // {86400 * R.SECOND} AS day, count(*) AS n FROM ev GROUP BY 1)))"""
    ),
    "bounded_priors": P._sql(" UNION ALL ".join(map(_bounded_sql, KINDS))),
    "template_placement": P._sql(_placement_sql()),
    "bounded_density": P._sql(
        f"""SELECT x, round(CASE WHEN x < {GRID_LOW} OR x > {GRID_HIGH} THEN 0 ELSE s / (n * h * sqrt(2 * pi())) END, 9) AS density FROM (
        SELECT x, n, h, sum(exp(-0.5 * pow((x - stat) / h, 2)) + exp(-0.5 * pow((2 * {GRID_LOW} - x - stat) / h, 2)) + exp(-0.5 * pow((2 * {GRID_HIGH} - x - stat) / h, 2))) AS s
        FROM (SELECT unnest({GRID}::DOUBLE[]) AS x), ev, (SELECT count(*) AS n, stddev_samp(stat) * pow(count(*), -0.2) AS h FROM ev) GROUP BY x, n, h)"""
    ),
    "segment_choice": P._sql(
        f"""SELECT inj_id, seg_id, s + floor({K.uniform_sql("inj_id", PRIOR_SEED, 1)} * (e - s))::BIGINT AS at_second FROM (
        SELECT inj_id, floor({K.uniform_sql("inj_id", PRIOR_SEED)} * (SELECT sum(e - s) FROM spn))::BIGINT AS place FROM inj) JOIN (
        SELECT *, sum(e - s) OVER (ORDER BY seg_id) AS upto FROM spn) ON place < upto AND place >= upto - (e - s)""",
        f'spn AS (SELECT time // {1800 * R.SECOND} AS seg_id, min(time) // {R.SECOND} AS s, max(time) // {R.SECOND} AS e FROM ev GROUP BY 1)',
    ),
    "score_losses": P._sql(
        """SELECT event_type, round(avg(p), 6) AS mean_score, round(avg(CASE WHEN target >= 0 THEN pow(p - target, 2.0) END), 6) AS masked_error,
        round(avg(exp(0.5 - (0.3 * (p - 0.5) + (p - 0.5) * pow(abs(p - 0.5), 2.0)))), 6) AS power_loss, max(2006 + event_id) AS last_seed,
        max(pow(2.0, ceil(log2((event_id + 1)::DOUBLE))))::BIGINT AS padded
        FROM (SELECT event_type, event_id, 1 / (1 + exp(-((stat - 250) / 100))) AS p, CASE WHEN event_type = 'view' THEN -1.0 ELSE stat / 500 END AS target FROM ev) GROUP BY event_type"""
    ),
}
