"""Queries of interval algebra and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.operators import intervals as I
from quaver.session import stored
from quaver.sources import roles as R

HOUR = 3600 * R.SECOND
#: Spans of activity, by expression over events: nested and overlapping, and shorter ones.
LONG, SHORT = "user_id * 100000 + time div 172800000000", "user_id * 1000000 + time div 7200000000"
LONG_SQL, SHORT_SQL = "user_id * 100000 + time // 172800000000", "user_id * 1000000 + time // 7200000000"


def _hours(spark, d):
    """Disjoint observing ranges: the first 5 of every 6 hours that have events."""
    rows = R.events(spark, d).select(F.expr(f"time div {6 * HOUR}").alias("seg_id")).distinct()
    return rows.select("seg_id", (F.col("seg_id") * 6 * HOUR).alias("start"), (F.col("seg_id") * 6 * HOUR + 5 * HOUR).alias("end"))


def _vetoes(spark, d):
    rows = R.injections(spark, d)
    return rows.select((F.col("tc") - 30 * R.SECOND).alias("start"), (F.col("tc") + 30 * R.SECOND).alias("end"))


def _padded(spark, d):
    pad = 30 * R.SECOND
    rows = _hours(spark, d)
    return rows.select("seg_id", (F.col("start") + pad).alias("start"), (F.col("end") - pad).alias("end"))


def _intersect(spark, d):
    """Common observing time of every odd user's span with every even user's."""
    rows = stored(R.segments(spark, d, SHORT), "spans")
    left = rows.where("seg_id div 1000000 % 2 = 1").select(F.col("seg_id").alias("left_id"), "start", "end")
    right = rows.where("seg_id div 1000000 % 2 = 0").select(F.col("seg_id").alias("right_id"), "start", "end")
    return I.overlaps(left, right, HOUR)


QUERIES = {
    "injections_in_segments": lambda s, d: I.points_in(R.injections(s, d).select("inj_id", "tc"), _padded(s, d), "tc"),
    "glitch_in_segment_count": lambda s, d: I.points_in(R.background(s, d), R.segments(s, d, SHORT), "time").agg(F.count("*").alias("n")),
    "raw_segment_lookup": lambda s, d: I.first_containing(R.segments(s, d, SHORT), R.segments(s, d, LONG)),
    "interval_coalesce": lambda s, d: I.coalesce(R.segments(s, d, SHORT).select("start", "end")),
    "interval_subtract": lambda s, d: I.subtract(_hours(s, d), _vetoes(s, d), 60 * R.SECOND),
    "interval_intersect": _intersect,
    "cumulative_offsets": lambda s, d: I.offsets(R.segments(s, d, SHORT)),
    "band_join_max": lambda s, d: I.band_max(R.injections(s, d).select("inj_id", "tc"), "tc", R.triggers(s, d), 300 * R.SECOND),
    "interval_neighbours": lambda s, d: I.gaps(R.segments(s, d, SHORT)).drop("start", "end"),
}

_SHORT = f"sh AS (SELECT {SHORT_SQL} AS seg_id, min(time) AS start, max(time) AS \"end\" FROM ev GROUP BY 1)"
_LONG = f"lg AS (SELECT {LONG_SQL} AS seg_id, min(time) AS start, max(time) AS \"end\" FROM ev GROUP BY 1)"
_HOURS = f"hr AS (SELECT DISTINCT time // {6 * HOUR} AS seg_id, time // {6 * HOUR} * {6 * HOUR} AS start, time // {6 * HOUR} * {6 * HOUR} + {5 * HOUR} AS \"end\" FROM ev)"
_MERGE = """
mr AS (SELECT *, max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM src),
isl AS (SELECT *, sum(CASE WHEN start <= top THEN 0 ELSE 1 END) OVER (ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM mr),
co AS (SELECT min(start) AS start, max("end") AS "end" FROM isl GROUP BY i)
"""


def _sql(select: str, *parts: str) -> str:
    return f"WITH {','.join([R.SQL, *parts])} {select}"


ORACLES = {
    "injections_in_segments": _sql(
        f'SELECT inj_id, tc FROM inj WHERE EXISTS (SELECT 1 FROM hr WHERE tc >= start + {30 * R.SECOND} AND tc <= "end" - {30 * R.SECOND})', _HOURS
    ),
    "glitch_in_segment_count": _sql('SELECT count(*) AS n FROM bg WHERE EXISTS (SELECT 1 FROM sh WHERE bg.time BETWEEN start AND "end")', _SHORT),
    "raw_segment_lookup": _sql(
        'SELECT s.seg_id, s.start, s."end", (SELECT arg_min(l.seg_id, (l.start, l.seg_id)) FROM lg l WHERE l.start <= s.start AND l."end" >= s."end") AS raw_id FROM sh s', _SHORT, _LONG
    ),
    "interval_coalesce": _sql('SELECT start, "end" FROM co', _SHORT, "src AS (SELECT start, \"end\" FROM sh)", _MERGE),
    "interval_subtract": _sql(
        f"""SELECT a AS start, b AS "end" FROM (
            SELECT v1 AS a, coalesce(lead(v0) OVER (PARTITION BY h0 ORDER BY v0), h1) AS b FROM hit
            UNION ALL SELECT h0, min(v0) FROM hit GROUP BY h0
            UNION ALL SELECT start, "end" FROM hr WHERE start NOT IN (SELECT h0 FROM hit)) WHERE b - a > {60 * R.SECOND}""",
        _HOURS, f"src AS (SELECT tc - {30 * R.SECOND} AS start, tc + {30 * R.SECOND} AS \"end\" FROM inj)", _MERGE,
        'hit AS (SELECT hr.start AS h0, hr."end" AS h1, co.start AS v0, co."end" AS v1 FROM hr JOIN co ON co.start < hr."end" AND co."end" > hr.start)',
    ),
    "interval_intersect": _sql(
        """SELECT a.seg_id AS left_id, b.seg_id AS right_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM sh a JOIN sh b
        ON a.seg_id // 1000000 % 2 = 1 AND b.seg_id // 1000000 % 2 = 0 AND greatest(a.start, b.start) < least(a."end", b."end")""", _SHORT
    ),
    "cumulative_offsets": _sql(
        'SELECT seg_id, start, "end", (sum("end" - start) OVER (ORDER BY start, seg_id ROWS UNBOUNDED PRECEDING) - ("end" - start))::BIGINT AS "offset" FROM sh', _SHORT
    ),
    "band_join_max": _sql(f"SELECT inj_id, tc, coalesce(max(t.stat), '-infinity'::DOUBLE) AS best FROM inj LEFT JOIN trig t ON t.time BETWEEN tc - {300 * R.SECOND} AND tc + {300 * R.SECOND} GROUP BY inj_id, tc"),
    "interval_neighbours": _sql('SELECT seg_id, lag("end") OVER (ORDER BY start, seg_id) AS end_before, lead(start) OVER (ORDER BY start, seg_id) AS start_after FROM sh', _SHORT),
}
