"""Queries of training samples, validation reports and whole evaluations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import astro as A
from quaver.functions.bounds import Triangle, spin_components
from quaver.operators import counters as K
from quaver.operators import intervals as I
from quaver.operators import report as E
from quaver.operators import samples as M
from quaver.plans import compare, search
from quaver.plans.vectors import _samples
from quaver.session import new_path, table
from quaver.sinks import files as sinks
from quaver.sources import files as sources
from quaver.sources import roles as R

SEED, TAKEN, LENGTH, BATCH, HALF = 51, 120, 40, 64, 32
TRIANGLE = Triangle()
RANGES = TRIANGLE.normaliser_ranges((11.0, 11.2), (130.0, 350.0), (5.0, 15.0))


def _tell(*arrays: str):
    """First and last value of arrays."""
    return [F.get(a, F.lit(0) if end == "first" else F.size(a) - 1).alias(f"{a.lower()}_{end}") for a in arrays for end in ("first", "last")]


def manifest_samples(spark, d):
    """Each injection's noise sample: a drawn stretch of a segment, read by a manifest from the stored blocks of both detectors."""
    blocks = R.strain(spark, d)
    key = F.col("inj_id")
    rows = R.injections(spark, d).select("inj_id", (key % 16).alias("seg"), K.whole(key, SEED, TAKEN).alias("begin"), F.explode(F.array(*map(F.lit, R.DETECTORS))).alias("det"))
    manifest = rows.select(F.concat_ws("/", "inj_id", "det").alias("sample_id"), "det", "seg", "begin", F.lit(LENGTH).alias("n"))
    got = M.gathered(manifest, blocks, R.BLOCK)
    return got.select("sample_id", "seg", "begin", F.size("samples").alias("n"), *_tell("samples"), F.array_max("samples").alias("peak"))


def _pairs(spark, d):
    """Samples of two detectors: a vector's halves; odd labels are signals."""
    rows = _samples(spark, d)
    return rows.select("vec_id", (F.col("label") % 2).alias("target"), F.expr(f"vec_id div {BATCH}").alias("batch"), F.slice("a", 1, HALF).alias("H1"), F.slice("a", HALF + 1, HALF).alias("L1"))


def noise_repaired(spark, d):
    rows = M.repaired(_pairs(spark, d), "vec_id", "batch", F.col("target") == 0, list(R.DETECTORS), SEED)
    return rows.select("vec_id", "batch", "target", "H1_from", "L1_from", *_tell("H1", "L1"))


def cross_pairs(spark, d):
    rows = M.cross_paired(_pairs(spark, d), "vec_id", F.col("target") == 1, *R.DETECTORS, SEED, 0.6, 0.5)
    return rows.select("vec_id", "kind", "H1_from", "L1_from", *_tell("H1", "L1"))


def rescaled_signals(spark, d):
    """Signals at target ratios of four kinds, and at a new chirp distance."""
    key = F.col("vec_id")
    rows = _pairs(spark, d).where("target = 1").select("vec_id", "H1", (10 + key % 20).cast("double").alias("mc"), (100 + key % 77).cast("double").alias("distance"))
    own, out = F.sqrt(F.aggregate("H1", F.lit(0.0), lambda t, x: t + x * x)) * 8, None
    for kind in M.TARGETS:
        made = M.rescaled(rows, ["H1"], own, M.target_snr(kind, own, key, SEED)).withColumn("kind", F.lit(kind))
        out = made if out is None else out.unionByName(made)
    out = out.unionByName(M.moved(rows, ["H1"], K.uniform(key, SEED, 130.0, 350.0, stream=5)).withColumns({"kind": F.lit("moved"), "snr": F.lit(None).cast("double")}))
    return out.select("vec_id", "kind", *[F.round(c, 6).alias(c) for c in ("snr", "distance", "dchirp")], F.round(F.get("H1", F.lit(3)), 6).alias("sample"))


def _raw(spark, d):
    """Raw scores around zero, with parameters of the sample."""
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", ((F.col("n_chars") - 1500) / 500.0).alias("score"), (F.col("doc_id") % 101).cast("double").alias("mass"), (F.col("n_chars") % 59).cast("double").alias("spin"))
    labels = table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("target"))
    return docs.join(labels, "doc_id").drop("doc_id")


def epoch_report(spark, d):
    """Parts of a validation report in one table: detected shares by bins of a parameter, and parameters by bands of scores."""
    bins = E.detected_by_bin(_raw(spark, d), "mass").select(F.lit("detected").alias("part"), F.col("bin").alias("key"), F.col("score").alias("x"), F.round("fraction", 9).alias("y"))
    bands = E.banded_histograms(_raw(spark, d), ["mass", "spin"])
    return bins.unionByName(bands.select(F.concat(F.lit("band of "), "parameter").alias("part"), F.col("band").alias("key"), F.col("bin").cast("double").alias("x"), F.col("n").cast("double").alias("y")))


def _stored_evaluation(rows, tag: str):
    spark = rows.sparkSession
    path = new_path(spark, tag)
    sinks.write_evaluation(rows, path)
    return sources.read_evaluation(spark, path)


def evaluation(spark, d):
    """The product of an evaluation: along the false alarms of the background, alarms a month, volume, distance and share found; written and read again."""
    rows = search._volume(spark, d, True).join(compare.far_per_month(spark, d).select("event_id", "rank", "per_month"), "event_id")
    return _stored_evaluation(rows, "evaluation")


def evaluation_compared(spark, d):
    """Two evaluations, with and without chirp weights, side by side at the levels of alarms that both have."""
    levels = F.col("rank").isin(2, 5, 10, 20, 50, 100, 1000)
    rates = compare.far_per_month(spark, d).where(levels).select("event_id", "rank", "per_month")
    sides = [search._volume(spark, d, chirp).select("event_id", F.col("distance").alias(name)) for chirp, name in ((True, "chirp"), (False, "plain"))]
    rows = rates.join(sides[0], "event_id").join(sides[1], "event_id")
    return rows.select("rank", "per_month", "chirp", "plain", F.round(F.when(F.col("plain") > 0, F.col("chirp") / F.col("plain")), 4).alias("ratio"))


def normalised_parameters(spark, d):
    """Seven parameters of each injection between the ends of their ranges, bounds of the chirp times and of the ratio, and spin components."""
    rows = R.injections(spark, d)
    mc, q = F.col("mc"), F.col("mass1") / F.col("mass2")
    values = {"tc": 11.0 + F.col("inj_id") % 20 / 100, "mchirp": mc, "dist": A.distance(F.col("chirp_distance"), mc), "dchirp": F.col("chirp_distance"), "q": q, "invq": 1 / q, "snr": F.col("snr")}
    tau0 = F.lit(TRIANGLE.chirp_scales[0]) * F.pow(mc * A.MTSUN, F.lit(-5 / 3))
    least, most = TRIANGLE.tau3_bounds(tau0)
    spin = spin_components(F.col("snr") / 16, F.col("inj_id") % 7, F.col("inj_id") % 3)
    more = {"tau3_low": least, "tau3_high": most, "q_high": TRIANGLE.ratio_bound(mc)} | dict(zip(("spin_x", "spin_y", "spin_z"), spin))
    return rows.select("inj_id", *[F.round(A.normalised(v, *RANGES[k]), 6).alias(f"norm_{k}") for k, v in values.items()], *[(F.round(v, 6) + F.lit(0.0)).alias(k) for k, v in more.items()])


def _spans(spark, d):
    rows = R.segments(spark, d, f"time div {1800 * R.SECOND}")
    return rows.select("seg_id", *[F.expr(f"{c} div {R.SECOND}").alias(c) for c in ("start", "end")])


def segment_checks(spark, d):
    """Segments long enough, by their number for training or validation; those that a veto of a quiet half hour's loudest event would hit; and spans of users that overlap."""
    spans = _spans(spark, d).where("end - start - 60 >= 600")
    numbered = I.numbered(spans)
    loud = R.events(spark, d).where("stat > 250").select(F.expr(f"time div {R.SECOND}").alias("at"))
    hit = I.holding(spans, loud, "at")
    rows = numbered.join(hit.select("seg_id", F.lit(True).alias("vetoed")), "seg_id", "left")
    rows = rows.select("seg_id", "number", F.when(F.col("number") <= 132, "training").otherwise("validation").alias("part"), F.coalesce("vetoed", F.lit(False)).alias("vetoed"))
    users = R.segments(spark, d, "user_id * 1000000 + time div 7200000000")
    return rows.unionByName(I.overlapping(users).select("seg_id", F.lit(None).cast("long").alias("number"), F.lit("overlap").alias("part"), F.lit(None).cast("boolean").alias("vetoed")))


def strain_slice(spark, d):
    """One detector's samples of a few segments between two blocks, read back from the stored series: folders and row groups beyond are not read."""
    path = new_path(spark, "series")
    sinks.write_blocks(R.strain(spark, d), path)
    rows = sources.read_blocks(spark, path, ["L1"], (3, 9), (1, 2))
    return rows.select("det", "seg", "block", F.size("samples").alias("n"), *_tell("samples"))


QUERIES = {
    "manifest_samples": manifest_samples,
    "noise_repaired": noise_repaired,
    "cross_pairs": cross_pairs,
    "rescaled_signals": rescaled_signals,
    "epoch_report": epoch_report,
    "evaluation": evaluation,
    "evaluation_compared": evaluation_compared,
    "normalised_parameters": normalised_parameters,
    "segment_checks": segment_checks,
    "strain_slice": strain_slice,
}


def _sql(select: str, *parts: str) -> str:
    return f"WITH {','.join([R.SQL, R.STRAIN, *parts])} {select}"


def _d(key: str, stream: int = 0) -> str:
    return K.draw_sql(key, SEED, stream)


def _u(key: str, stream: int = 0) -> str:
    return K.uniform_sql(key, SEED, stream)


def _ends(array: str, name: str) -> str:
    return f"{array}[1] AS {name}_first, {array}[len({array})] AS {name}_last"


def _c(p: float) -> int:
    return round(p * K.RANGE)


def _rescaled_sql() -> str:
    ref = A.REFERENCE_MASS / 2**0.2
    targets = {"uniform": f"5 + 10 * {_u('vec_id')}", "half_normal": f"abs({K.normal_sql('vec_id', SEED)}) * 4 + 5", "plus_five": "own + 5", "fixed": "5.0"}
    base = "sg AS (SELECT vec_id, h, (10 + vec_id % 20)::DOUBLE AS mc, (100 + vec_id % 77)::DOUBLE AS distance, sqrt(list_sum(list_transform(h, lambda x: x * x))) * 8 AS own FROM pr WHERE target = 1)"
    parts = [
        f"SELECT vec_id, '{k}' AS kind, round(t, 6) AS snr, round(distance / (t / own), 6) AS distance, round(distance / (t / own) * pow({ref!r}::DOUBLE / mc, 5.0::DOUBLE / 6), 6) AS dchirp, round(h[4] * (t / own), 6) AS sample FROM (SELECT *, ({t})::DOUBLE AS t FROM sg)"
        for k, t in targets.items()
    ]
    far = f"SELECT *, dchirp * pow(mc / {ref!r}::DOUBLE, 5.0::DOUBLE / 6) AS new FROM (SELECT *, 130 + 220 * {_u('vec_id', 5)} AS dchirp FROM sg)"
    parts.append(f"SELECT vec_id, 'moved', NULL, round(new, 6), round(dchirp, 6), round(h[4] * distance / new, 6) FROM ({far})")
    return f"WITH {_PAIRS}, {base} " + " UNION ALL ".join(parts)


_PAIRS = f"pr AS (SELECT vec_id, label % 2 AS target, vec_id // {BATCH} AS batch, embedding[1:{HALF}]::DOUBLE[] AS h, embedding[{HALF + 1}:{2 * HALF}]::DOUBLE[] AS l FROM embeddings WHERE embedding IS NOT NULL)"
_RAW = "rw AS (SELECT (n_chars - 1500) / 500.0::DOUBLE AS score, (doc_id % 101)::DOUBLE AS mass, (n_chars % 59)::DOUBLE AS spin, quality AS target FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)"


def _report_sql() -> str:
    bins = """SELECT 'detected' AS part, b::INT AS key, n.score AS x, round(count(*) FILTER (WHERE s.score > n.score) / count(*), 9) AS y FROM
        (SELECT DISTINCT score FROM rw WHERE target = 0) n, (SELECT *, lo + (hi - lo) * b / 4 AS a, CASE b WHEN 3 THEN hi ELSE lo + (hi - lo) * (b + 1) / 4 END AS z
        FROM rw, (SELECT min(mass) AS lo, max(mass) AS hi FROM rw WHERE target = 1), range(4) r(b) WHERE target = 1) s WHERE mass > a AND mass < z GROUP BY b, n.score"""
    bands = """SELECT 'band of ' || parameter, band, bin::DOUBLE, count(*)::DOUBLE FROM (
        SELECT band, parameter, CASE WHEN hi > lo THEN least(floor((v - lo) * 100.0 / (hi - lo)), 99) ELSE 0 END::INT AS bin FROM (
        SELECT *, min(v) OVER (PARTITION BY band, parameter) AS lo, max(v) OVER (PARTITION BY band, parameter) AS hi FROM (
        SELECT band, unnest(['mass', 'spin']) AS parameter, unnest([mass, spin]) AS v FROM rw JOIN bd ON score > a AND score < z WHERE target = 1))) GROUP BY ALL"""
    edges = """st AS (SELECT (SELECT min(score) FROM rw WHERE target = 1) AS least, (SELECT max(score) FROM rw WHERE target = 1) AS most, (SELECT max(score) FROM rw WHERE target = 0) AS top),
        md AS (SELECT median(score) AS mid FROM rw, st WHERE target = 1 AND score > top),
        bd AS (SELECT unnest([-1, 0, 1, 2, 3, 4, 5, 6])::INT AS band, unnest(['-infinity'::DOUBLE, least, least, 0, top, top, mid, 0]) AS a, unnest(['infinity'::DOUBLE, 0, top, top, most, mid, most, most]) AS z FROM st, md)"""
    return f"WITH {_RAW}, {edges} {bins} UNION ALL {bands}"


def _parameters_sql() -> str:
    from quaver.plans.draws import _other

    t, ref, sun = TRIANGLE, A.REFERENCE_MASS / 2**0.2, A.MTSUN
    a0, a3 = t.chirp_scales
    values = {"tc": "11.0::DOUBLE + (inj_id % 20) / 100.0", "mchirp": "mc", "dist": f"chirp_distance * pow(mc / {ref!r}::DOUBLE, 5.0::DOUBLE / 6)", "dchirp": "chirp_distance", "q": "mass1 / mass2", "invq": "1 / (mass1 / mass2)", "snr": "snr"}
    norm = ", ".join(f"round((({v}) - {float(RANGES[k][0])!r}::DOUBLE) / {float(RANGES[k][1]) - float(RANGES[k][0])!r}::DOUBLE, 6) AS norm_{k}" for k, v in values.items())
    tau3 = lambda m, n: f"{a3!r}::DOUBLE * pow(({m} + {n}) * {sun!r}::DOUBLE, -2.0::DOUBLE / 3) * ({m} + {n}) * ({m} + {n}) / ({m} * {n})"
    low, high = str(t.low), str(t.high)
    beside = f"SELECT *, {a0!r}::DOUBLE * pow(mc * {sun!r}::DOUBLE, -5.0::DOUBLE / 3) AS tau0, {_other('mc', low)} AS by_low, {_other('mc', high)} AS by_high FROM inj"
    turn = (t.high * t.low) ** 0.6 / (t.high + t.low) ** 0.2
    more = f"""round({4 * a3!r}::DOUBLE * pow(tau0 / {4 * a0!r}::DOUBLE, 0.4), 6) AS tau3_low,
        round(CASE WHEN tau0 > {t.tau0(t.high, t.low)!r} THEN {tau3('by_low', low)} ELSE {tau3(high, 'by_high')} END, 6) AS tau3_high,
        round(CASE WHEN mc > {turn!r} THEN {high} / by_high ELSE by_low / {low} END, 6) AS q_high,
        round(snr / 16.0 * sin(inj_id % 3) * cos(inj_id % 7), 6) + 0.0 AS spin_x, round(snr / 16.0 * sin(inj_id % 3) * sin(inj_id % 7), 6) + 0.0 AS spin_y, round(snr / 16.0 * cos(inj_id % 3), 6) + 0.0 AS spin_z"""
    return search._sql(f"SELECT inj_id, {norm}, {more} FROM ({beside})")


_SPANS = f'spn AS (SELECT time // {1800 * R.SECOND} AS seg_id, min(time) // {R.SECOND} AS start, max(time) // {R.SECOND} AS "end" FROM ev GROUP BY 1 HAVING max(time) // {R.SECOND} - min(time) // {R.SECOND} - 60 >= 600)'
_LEVELS = "(2, 5, 10, 20, 50, 100, 1000)"
ORACLES = {
    "manifest_samples": _sql(
        f"""SELECT inj_id || '/' || m.det AS sample_id, m.seg, place AS begin, count(pos)::INT AS n, arg_min(v, pos) AS samples_first, arg_max(v, pos) AS samples_last, max(v) AS peak FROM (
        SELECT inj_id, inj_id % 16 AS seg, floor({_u('inj_id')} * {TAKEN})::BIGINT AS place, unnest(['H1', 'L1']) AS det FROM inj) m
        LEFT JOIN smp s ON s.det = m.det AND s.seg = m.seg AND pos BETWEEN place AND place + {LENGTH - 1} GROUP BY ALL"""
    ),
    "noise_repaired": f"""WITH {_PAIRS}, ns AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY vec_id) AS r, row_number() OVER (PARTITION BY batch ORDER BY {_d('vec_id', 0)}, vec_id) AS rh,
        row_number() OVER (PARTITION BY batch ORDER BY {_d('vec_id', 1)}, vec_id) AS rl FROM pr WHERE target = 0)
        SELECT n.vec_id, n.batch, n.target, a.vec_id AS "H1_from", b.vec_id AS "L1_from", {_ends('a.h', 'h1')}, {_ends('b.l', 'l1')}
        FROM ns n JOIN ns a ON a.batch = n.batch AND a.rh = n.r JOIN ns b ON b.batch = n.batch AND b.rl = n.r
        UNION ALL SELECT vec_id, batch, target, vec_id, vec_id, {_ends('h', 'h1')}, {_ends('l', 'l1')} FROM pr WHERE target <> 0""",
    "cross_pairs": f"""WITH {_PAIRS}, sg AS (SELECT *, row_number() OVER (ORDER BY {_d('vec_id', 9)}, vec_id) - 1 AS i, count(*) OVER () AS n FROM pr WHERE target = 1), cn AS (SELECT count(*) AS n FROM sg),
        pk AS (SELECT *, (a + 1 + floor({_u('vec_id', 2)} * (n - 1))::BIGINT) % n AS b FROM (
        SELECT pr.*, n, floor({_u('vec_id', 1)} * n)::BIGINT AS a, CASE WHEN {_d('vec_id', 3)} < {_c(0.5)} THEN 'both' WHEN {_d('vec_id', 4)} < {_c(0.5)} THEN 'H1' ELSE 'L1' END AS kind FROM pr, cn WHERE target = 0 AND {_d('vec_id')} < {_c(0.6)}))
        SELECT p.vec_id, kind, CASE kind WHEN 'L1' THEN p.vec_id ELSE s.vec_id END AS "H1_from", CASE kind WHEN 'H1' THEN p.vec_id ELSE t.vec_id END AS "L1_from",
        {_ends("(CASE kind WHEN 'L1' THEN p.h ELSE s.h END)", 'h1')}, {_ends("(CASE kind WHEN 'H1' THEN p.l ELSE t.l END)", 'l1')} FROM pk p JOIN sg s ON s.i = p.a JOIN sg t ON t.i = p.b""",
    "rescaled_signals": _rescaled_sql(),
    "epoch_report": _report_sql(),
    "evaluation": f"SELECT a.*, b.rank, b.per_month FROM ({search.ORACLES['sensitive_volume_chirp']}) a JOIN ({compare.ORACLES['far_per_month']}) b USING (event_id)",
    "evaluation_compared": f"""SELECT b.rank, b.per_month, a.distance AS chirp, c.distance AS plain, round(CASE WHEN c.distance > 0 THEN a.distance / c.distance END, 4) AS ratio
        FROM ({search.ORACLES['sensitive_volume_chirp']}) a JOIN ({compare.ORACLES['far_per_month']}) b USING (event_id) JOIN ({search.ORACLES['sensitive_volume_plain']}) c USING (event_id) WHERE b.rank IN {_LEVELS}""",
    "normalised_parameters": _parameters_sql(),
    "segment_checks": _sql(
        f"""SELECT seg_id, row_number() OVER (ORDER BY start, seg_id) - 1 AS number, CASE WHEN row_number() OVER (ORDER BY start, seg_id) - 1 <= 132 THEN 'training' ELSE 'validation' END AS part,
        EXISTS (SELECT 1 FROM ev WHERE stat > 250 AND time // {R.SECOND} BETWEEN start AND "end") AS vetoed FROM spn
        UNION ALL SELECT seg_id, NULL, 'overlap', NULL FROM (SELECT seg_id, start, max("end") OVER (ORDER BY start, "end", seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
        FROM (SELECT user_id * 1000000 + time // 7200000000 AS seg_id, min(time) AS start, max(time) AS "end" FROM ev GROUP BY 1)) WHERE start < top""",
        _SPANS,
    ),
    "strain_slice": _sql(f"SELECT det, seg, pos // {R.BLOCK} AS block, count(*)::INT AS n, arg_min(v, pos) AS samples_first, arg_max(v, pos) AS samples_last FROM smp WHERE det = 'L1' AND seg BETWEEN 3 AND 9 AND pos // {R.BLOCK} BETWEEN 1 AND 2 GROUP BY ALL"),
}
