"""Queries over sample series: windows, the search end to end, slides, budgets, partitions; and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quaver.operators import budget as B
from quaver.operators import counters as K
from quaver.operators import intervals as I
from quaver.operators import search as S
from quaver.operators import series as W
from quaver.session import new_path
from quaver.sinks import files as sinks
from quaver.sources import files as sources
from quaver.sources import roles as R

STEP, SPAN, PEAK = 4, 24, 17
THRESHOLD, GAP, VAR = 330.0, 7 * R.SECOND, 0.3
SEED, CUT = 11, 200
#: A budget in seconds, over spans of activity; and one in samples, over segments a thousand blocks apart.
BUDGET = {"offset": 90_000, "minimum": 600, "slide": 60}
DURATION, SEGMENT = 400_000, 1000 * R.BLOCK
NOISE = {"offset": 250, "minimum": 100, "slide": 40}
NOISE_DURATION = 1000


def _windows(spark, d):
    rows = W.windows(R.strain(spark, d), list(R.DETECTORS), R.BLOCK, STEP, SPAN)
    return rows.withColumn("time", W.time_of(F.col("k"), F.col("seg") * R.APART, STEP, R.TICK, PEAK * R.TICK))


def test_windows(spark, d):
    """Every window of both detectors, with what tells its samples: the first and last ones, their greatest and their sum."""
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, x: t + x), 4)
    return _windows(spark, d).select("index", "seg", "k", "time", F.get("H1", F.lit(0)).alias("h_first"), F.get("L1", F.lit(SPAN - 1)).alias("l_last"), F.array_max("H1").alias("h_max"), total("L1").alias("l_sum"))


def window_lookup(spark, d):
    """Segment and place of window numbers; every event asks for one."""
    plan = W.hop_plan(W.common_lengths(R.strain(spark, d), list(R.DETECTORS)), STEP, SPAN)
    asked = R.events(spark, d).select("event_id", F.expr("event_id div 6").alias("index"))
    return W.locate(asked, plan)


def loudness(matrices: dict[str, np.ndarray]) -> np.ndarray:
    """A stand-in for a trained model: the sum of the detectors' greatest samples."""
    return sum(m.max(axis=1) for m in matrices.values())


def search_end_to_end(spark, d):
    """Windows, scores, triggers, clusters, and the event file, written and read again."""
    raw = W.scored(_windows(spark, d).select("index", "time", *R.DETECTORS), loudness, list(R.DETECTORS))
    triggers = raw.where(F.col("raw") > THRESHOLD).select(F.col("index").alias("event_id"), "time", F.col("raw").alias("stat"))
    events = S.clusters(triggers, GAP).select(F.col("time").cast("double").alias("time"), "stat", F.lit(VAR).alias("var"))
    path = new_path(spark, "event-file")
    sinks.write_events(events, path)
    return sources.read_events(spark, [path])


def time_slides(spark, d):
    """The first and last sample of each aligned block after independent shifts, for each way to shift."""
    blocks, out = R.strain(spark, d), None
    for mode in W.MODES:
        plan = W.slide_plan(R.extents(blocks), list(R.DETECTORS), mode, SEED, CUT)
        rows = W.aligned(W.cut(blocks, plan, R.BLOCK), list(R.DETECTORS))
        rows = rows.select(F.lit(mode).alias("mode"), "seg", "block", F.size("H1").alias("n"), F.get("H1", F.lit(0)).alias("h_first"), F.element_at("L1", -1).alias("l_last"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _hours(spark, d):
    from quaver.plans.spans import _hours

    return _hours(spark, d)


def shifted_injections(spark, d):
    """Injections that count from 0, placed into observing ranges laid end to end."""
    rows = R.injections(spark, d).select("inj_id", (F.col("inj_id") * 200 * R.SECOND).alias("tc"))
    return W.shifted_injections(rows, _hours(spark, d), 30 * R.SECOND, 20 * R.SECOND)


def _spans(spark, d):
    rows = R.segments(spark, d, f"time div {1800 * R.SECOND}")
    return rows.select("seg_id", *[F.expr(f"{c} div {R.SECOND}").alias(c) for c in ("start", "end")])


def segment_budget(spark, d):
    """Which seconds are for testing and which are left for training."""
    spans = _spans(spark, d)
    tested = B.testing(spans, DURATION, **BUDGET)
    trained = B.training(spans, tested, **BUDGET)
    return tested.withColumn("mode", F.lit("testing")).unionByName(trained.withColumn("mode", F.lit("training")))


def noise_partition(spark, d):
    """Noise for testing and for training: budgeted segments, the raw segment around each, the second detector shifted within it, cut and stored in blocks."""
    blocks = R.strain(spark, d)
    raw = W.common_lengths(blocks, list(R.DETECTORS)).select(F.col("seg").alias("seg_id"), (F.col("seg") * SEGMENT).alias("start"), (F.col("seg") * SEGMENT + F.col("n")).alias("end"))
    tested = B.testing(raw, NOISE_DURATION, **NOISE)
    out = None
    for mode, picked in (("testing", tested), ("training", B.training(raw, tested, **NOISE))):
        # A picked segment that no raw one holds would be lost data: the lookup then has no id, and the stored rows show it.
        within = I.first_containing(picked, raw).join(raw.select(F.col("seg_id").alias("raw_id"), F.col("start").alias("_s")), "raw_id", "left")
        wanted = within.select(F.col("raw_id").alias("seg"), (F.col("start") - F.col("_s")).alias("_at"), (F.col("end") - F.col("start") - NOISE["slide"]).alias("_n")).where("_n > 0")
        sizes = W.lengths(blocks).join(wanted, "seg")
        # The first detector keeps its place, the second moves within the slide at most.
        moved = K.whole(F.col("seg"), SEED + 1, F.least(F.lit(NOISE["slide"]), F.col("n") - F.col("_at") - F.col("_n")) + 1)
        begin = F.col("_at") + F.when(F.col("det") == R.DETECTORS[0], F.lit(0)).otherwise(moved)
        cut = W.cut(blocks, sizes.select("det", "seg", F.col("_n").alias("n"), begin.alias("begin")), R.BLOCK)
        path = new_path(spark, f"noise-{mode}")
        sinks.write_blocks(cut, path)
        rows = sources.read_blocks(spark, path).groupBy("det", "seg").agg(F.sum(F.size("samples")).alias("n"), F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda t, x: t + x)), 4).alias("total"))
        rows = rows.select(F.lit(mode).alias("mode"), "det", F.col("seg").cast("long").alias("seg"), "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "test_windows": test_windows,
    "window_lookup": window_lookup,
    "search_end_to_end": search_end_to_end,
    "time_slides": time_slides,
    "shifted_injections": shifted_injections,
    "segment_budget": segment_budget,
    "noise_partition": noise_partition,
}

_PLAN = f"""
pl0 AS (SELECT seg, greatest(0, (n - {SPAN}) // {STEP}) AS windows FROM cm),
pl AS (SELECT *, (sum(windows) OVER (ORDER BY seg ROWS UNBOUNDED PRECEDING) - windows)::BIGINT AS "first" FROM pl0),
wn AS (SELECT seg, "first", unnest(range(windows)) AS k FROM pl),
win AS (
  SELECT "first" + k AS "index", seg, k, seg * {R.APART} + k * {STEP * R.TICK} + {PEAK * R.TICK} AS time,
    max(CASE WHEN det = 'H1' AND pos = k * {STEP} THEN v END) AS h_first, max(CASE WHEN det = 'L1' AND pos = k * {STEP} + {SPAN - 1} THEN v END) AS l_last,
    max(CASE WHEN det = 'H1' THEN v END) AS h_max, max(CASE WHEN det = 'L1' THEN v END) AS l_max, round(sum(CASE WHEN det = 'L1' THEN v END), 4) AS l_sum
  FROM wn JOIN smp USING (seg) WHERE pos BETWEEN k * {STEP} AND k * {STEP} + {SPAN - 1} GROUP BY seg, "first", k)
"""


def _sql(select: str, *parts: str) -> str:
    return f"WITH {','.join([R.SQL, R.STRAIN, *parts])} {select}"


def _budget_sql(source: str, duration: int, offset: int, minimum: int, slide: int, buffer: int = 8) -> str:
    """The fold itself, a segment a step; the training mode skips what the testing mode took."""

    def fold(name: str, total: int) -> str:
        fits = f'len - {slide} >= {minimum} AND NOT past - {offset} >= {total}'
        return f"""
{name} AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS past, NULL::BIGINT AS seg_id, NULL::BIGINT AS s, NULL::BIGINT AS e
  UNION ALL
  SELECT i, CASE WHEN NOT ({fits}) THEN past WHEN past + len < {offset} THEN past + len - {slide}
      WHEN e0 - s1 - {slide} < {minimum} THEN greatest(past, {offset}) ELSE greatest(past, {offset}) + (e1 - s1) - {slide} END,
    CASE WHEN {fits} AND past + len >= {offset} AND e0 - s1 - {slide} >= {minimum} THEN seg_id END, s1, e1
  FROM (
    SELECT *, CASE WHEN greatest(past, {offset}) + (e0 - s1) - {slide} > {offset + total} THEN e0 - (greatest(past, {offset}) + (e0 - s1) - {offset + total + slide}) + {buffer} ELSE e0 END AS e1
    FROM (SELECT n.i, p.past, n.seg_id, n.start AS s0, n."end" AS e0, n."end" - n.start AS len, n.start + greatest(0, {offset} - p.past) AS s1 FROM {name} p JOIN num n ON n.i = p.i + 1)))"""

    return f"""
num AS (SELECT *, row_number() OVER (ORDER BY seg_id) AS i FROM {source}),
{fold("tst", duration)},
{fold("trn", 10**12)},
tested AS (SELECT seg_id, s AS start, e AS "end" FROM tst WHERE seg_id IS NOT NULL),
lst AS (SELECT start AS ls, "end" AS le FROM tested ORDER BY seg_id DESC LIMIT 1),
trained AS (
  SELECT seg_id, CASE WHEN s = ls THEN le + {buffer} ELSE s END AS start, e AS "end" FROM trn LEFT JOIN lst ON true
  WHERE seg_id IS NOT NULL AND (s, e) NOT IN (SELECT (start, "end") FROM tested) AND (ls IS NULL OR s <> ls OR e - le > {buffer})),
both_ AS (SELECT *, 'testing' AS mode FROM tested UNION ALL SELECT *, 'training' FROM trained)"""


def _slides_sql(mode: str) -> str:
    groups = {i: W.MODES[mode](i) for i in range(2)}
    draw = lambda g: f"floor({K.uniform_sql('seg', SEED, g)} * (high - low))::BIGINT"
    by = {d: ("NULL" if groups[i] is None else str(groups[i])) for i, d in enumerate(R.DETECTORS)}
    drawn = "CASE g " + " ".join(f"WHEN {g} THEN {draw(g)}" for g in sorted({g for g in groups.values() if g is not None})) + " END" if set(groups.values()) != {None} else "0"
    return f"""SELECT '{mode}' AS mode, seg, block, count(*) FILTER (WHERE det = 'H1')::INT AS n, arg_min(v, place) FILTER (WHERE det = 'H1') AS h_first, arg_max(v, place) FILTER (WHERE det = 'L1') AS l_last
FROM (
  SELECT det, seg, pos - begin AS place, (pos - begin) // {R.BLOCK} AS block, v FROM smp JOIN (
    SELECT det, seg, at0 + CASE WHEN g IS NULL OR low >= high THEN 0 ELSE low + {drawn} END AS begin FROM (
      SELECT *, max(-at0) OVER (PARTITION BY seg, g) AS low, min(n - at0 - {CUT}) OVER (PARTITION BY seg, g) AS high FROM (
        SELECT det, seg, n, s - start AS at0, CASE det WHEN 'H1' THEN {by['H1']} ELSE {by['L1']} END::INT AS g FROM ext JOIN (
          SELECT seg, max(start) AS s, min(start + n) AS e FROM ext GROUP BY seg HAVING count(*) = 2 AND min(start + n) - max(start) >= {CUT}) USING (seg)))) USING (det, seg)
  WHERE pos >= begin AND pos < begin + {CUT})
GROUP BY seg, block"""


_HOURS = f'hr AS (SELECT DISTINCT time // {21600 * R.SECOND} AS seg_id, time // {21600 * R.SECOND} * {21600 * R.SECOND} AS start, time // {21600 * R.SECOND} * {21600 * R.SECOND} + {18000 * R.SECOND} AS "end" FROM ev)'
_SPANS = f'spn AS (SELECT time // {1800 * R.SECOND} AS seg_id, min(time) // {R.SECOND} AS start, max(time) // {R.SECOND} AS "end" FROM ev GROUP BY 1)'
_RAW = f'raw AS (SELECT seg AS seg_id, seg * {SEGMENT} AS start, seg * {SEGMENT} + n AS "end" FROM cm)'
ORACLES = {
    "test_windows": _sql('SELECT "index", seg, k, time, h_first, l_last, h_max, l_sum FROM win', _PLAN),
    "window_lookup": _sql('SELECT event_id, event_id // 6 AS "index", wn.seg, wn.k FROM ev LEFT JOIN wn ON wn."first" + wn.k = event_id // 6', _PLAN),
    "search_end_to_end": _sql(
        f"""SELECT time::DOUBLE AS time, stat, {VAR}::DOUBLE AS var FROM (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY stat DESC, time, "index") AS r FROM (
          SELECT *, sum(CASE WHEN time - before <= {GAP} THEN 0 ELSE 1 END) OVER (ORDER BY time, "index") AS c FROM (
            SELECT *, lag(time) OVER (ORDER BY time, "index") AS before FROM (SELECT "index", time, h_max + l_max AS stat FROM win) WHERE stat > {THRESHOLD}))) WHERE r = 1""",
        _PLAN,
    ),
    "time_slides": _sql(" UNION ALL ".join(map(_slides_sql, W.MODES))),
    "shifted_injections": _sql(
        f"""SELECT inj_id, seg_id, inj_id * {200 * R.SECOND} + start - passed + {30 * R.SECOND} AS tc FROM inj JOIN (
        SELECT *, (sum("end" - start) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING) - ("end" - start))::BIGINT AS passed FROM hr)
        ON inj_id * {200 * R.SECOND} - passed + start + {30 * R.SECOND} BETWEEN start + {30 * R.SECOND} AND "end" - {20 * R.SECOND}""",
        _HOURS,
    ),
    "segment_budget": _sql("SELECT * FROM both_", _SPANS, _budget_sql("spn", DURATION, **BUDGET)).replace("WITH", "WITH RECURSIVE", 1),
    "noise_partition": _sql(
        f"""SELECT mode, det, seg, count(*) AS n, round(sum(v), 4) AS total FROM smp JOIN (
        SELECT mode, ln.det, ln.seg, place, n0, place + CASE WHEN ln.det = 'H1' THEN 0 ELSE floor({K.uniform_sql('ln.seg', SEED + 1)} * (least({NOISE['slide']}, ln.n - place - n0) + 1))::BIGINT END AS begin
        FROM ln JOIN (SELECT mode, seg_id AS seg, start - seg_id * {SEGMENT} AS place, "end" - start - {NOISE['slide']} AS n0 FROM both_) USING (seg) WHERE n0 > 0) USING (det, seg)
        WHERE pos >= begin AND pos < begin + n0 GROUP BY ALL""",
        _RAW, _budget_sql("raw", NOISE_DURATION, **NOISE),
    ).replace("WITH", "WITH RECURSIVE", 1),
}
