"""Queries of the event search and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.operators import search as S
from quaver.sources import roles as R

GAP, TIGHT, VAR, LOUD, MONTH = 600 * R.SECOND, 100, 1200 * R.SECOND, 20.0, 30.0


def _matched(spark, d):
    return S.nearest_injection(R.triggers(spark, d), R.injections(spark, d))


def _found(spark, d):
    best = S.best_true_positives(_matched(spark, d), VAR)
    return best.join(R.injections(spark, d).select("inj_id", "mc"), "inj_id")


def _curve(spark, d):
    return S.found_curve(R.background(spark, d), _found(spark, d))


def _loud(spark, d):
    return R.triggers(spark, d).where(F.col("stat") > LOUD).select("event_id", "time", "stat")


def _volume(spark, d, chirp):
    rows = S.sensitive_volume(_curve(spark, d), R.injections(spark, d), chirp)
    return rows.select("event_id", "stat", "n", *[F.round(c, 6).alias(c) for c in ("volume", "error", "distance", "fraction")])


def sensitive_volume_chirp(spark, d):
    return _volume(spark, d, True)


def far_background(spark, d):
    rows = S.false_alarm_rates(R.background(spark, d).select("event_id", "stat"), MONTH)
    return rows.select("event_id", "rank", F.round("far", 6).alias("far"))


def far_foreground(spark, d):
    noise = _matched(spark, d).where(~S.true_positive(VAR)).select("event_id", "stat")
    return S.false_alarm_rates(noise, MONTH).select("event_id", "rank", F.round("far", 6).alias("far"))


def found_at_level(spark, d):
    """Found injections louder than each level; the levels are at most five rows."""
    levels = S.far_levels(R.background(spark, d)).select("rank", F.col("stat").alias("level"))
    rows = _found(spark, d).join(F.broadcast(levels), F.col("stat") > F.col("level"))
    return rows.groupBy("rank").agg(F.count("*").alias("n_found"))


def efficiency_by_snr(spark, d):
    found = S.best_true_positives(_matched(spark, d), VAR).select("inj_id", F.lit(1).alias("f"))
    rows = R.injections(spark, d).select("inj_id", "snr").join(found, "inj_id", "left")
    return rows.groupBy("snr").agg(F.count("*").alias("n"), F.count("f").alias("n_found"), F.round(F.count("f") / F.count("*"), 6).alias("efficiency"))


def unique_pairs(spark, d):
    """Numbers of pairs (hour, kind) that only one of two teams has, or both."""
    rows = R.events(spark, d).select(F.expr("time div 3600000000").alias("hour"), "event_type", (F.col("user_id") % 2).alias("team"))
    teams = rows.groupBy("hour", "event_type").agg(F.min("team").alias("a"), F.max("team").alias("b"))
    return teams.select(F.when(F.col("a") < F.col("b"), "both").when(F.col("a") == 0, "first").otherwise("second").alias("side")).groupBy("side").agg(F.count("*").alias("n"))


QUERIES = {
    "trigger_threshold": lambda s, d: _loud(s, d),
    "trigger_clusters": lambda s, d: S.clusters(_loud(s, d), GAP),
    "trigger_clusters_tight": lambda s, d: S.clusters(_loud(s, d), TIGHT),
    "nearest_injection": lambda s, d: _matched(s, d).select("event_id", "inj_id", "dt"),
    "tp_fp_split": lambda s, d: _matched(s, d).select("event_id", S.true_positive(VAR).alias("tp")),
    "unmatched_injections": lambda s, d: R.injections(s, d).select("inj_id").join(_matched(s, d).select("inj_id"), "inj_id", "left_anti"),
    "best_true_positive": lambda s, d: S.best_true_positives(_matched(s, d), VAR),
    "true_missed": lambda s, d: R.injections(s, d).select("inj_id").join(S.best_true_positives(_matched(s, d), VAR), "inj_id", "left_anti"),
    "background_far": far_background,
    "foreground_far": far_foreground,
    "far_levels": lambda s, d: S.far_levels(R.background(s, d)),
    "found_at_level": found_at_level,
    "found_curve": lambda s, d: _curve(s, d).select("event_id", "stat", "n", F.round("m", 3).alias("m"), F.round("m2", 1).alias("m2")),
    "sensitive_volume_plain": lambda s, d: _volume(s, d, False),
    "sensitive_volume_chirp": sensitive_volume_chirp,
    "efficiency_by_snr": efficiency_by_snr,
    "unique_pairs_a_b_both": unique_pairs,
}

_MATCH = f"""
lft AS (SELECT t.*, i.tc AS ltc, i.inj_id AS lid FROM trig t ASOF LEFT JOIN inj i ON t.time >= i.tc),
both_ AS (SELECT l.*, i.tc AS rtc, i.inj_id AS rid FROM lft l ASOF LEFT JOIN inj i ON l.time < i.tc),
m AS (SELECT event_id, time, stat, CASE WHEN ltc IS NOT NULL AND (rtc IS NULL OR time - ltc < rtc - time) THEN lid ELSE rid END AS inj_id,
    CASE WHEN ltc IS NOT NULL AND (rtc IS NULL OR time - ltc < rtc - time) THEN time - ltc ELSE rtc - time END AS dt FROM both_),
best AS (SELECT inj_id, max(stat) AS stat FROM m WHERE dt <= {VAR} GROUP BY inj_id)
"""
_CURVE = """
fnd AS (SELECT best.inj_id, best.stat, pow(mc, 2.5)::DECIMAL(24,6) AS w, pow(mc, 5.0)::DECIMAL(24,6) AS w2 FROM best JOIN inj USING (inj_id)),
cv AS (SELECT b.event_id, b.stat, count(f.stat) AS n, coalesce(sum(f.w), 0)::DOUBLE AS m, coalesce(sum(f.w2), 0)::DOUBLE AS m2
    FROM bg b LEFT JOIN fnd f ON f.stat > b.stat GROUP BY b.event_id, b.stat)
"""


def _sql(select: str, *parts: str) -> str:
    return f"WITH {','.join([R.SQL, *parts])} {select}"


def _clusters_sql(gap: int) -> str:
    return _sql(
        "SELECT cluster_id::BIGINT AS cluster_id, event_id, time, stat, n FROM k WHERE r = 1",
        f"""b AS (SELECT *, CASE WHEN time - lag(time) OVER o <= {gap} THEN 0 ELSE 1 END AS brk FROM trig WHERE stat > {LOUD} WINDOW o AS (ORDER BY time, event_id)),
        c AS (SELECT *, sum(brk) OVER (ORDER BY time, event_id) AS cluster_id FROM b),
        k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stat DESC, time, event_id) AS r, count(*) OVER (PARTITION BY cluster_id) AS n FROM c)""",
    )


def _volume_sql(chirp: bool) -> str:
    scale = "(1.0 / (pow(top, 2.5) * cnt))" if chirp else "(1.0 / cnt)"
    total = "(pow(top, 2.5) * wt)" if chirp else "cnt"
    m, m2 = ("m", "m2") if chirp else ("n", "n")
    return _sql(
        f"""SELECT event_id, stat, n, round({scale} * {m}, 6) AS volume,
        round({scale} * sqrt(greatest(0.0, {total} * ({m2} / {total} - ({m} / {total}) * ({m} / {total})))), 6) AS error,
        round(pow({scale} * {m} * 3 / (4 * pi()), 1.0 / 3), 6) AS distance, round(n / {total}, 6) AS fraction
        FROM cv, (SELECT count(*)::DOUBLE AS cnt, max(mc) AS top, sum(pow(1.0 / mc, 2.5)::DECIMAL(24,15))::DOUBLE AS wt FROM inj)""",
        _MATCH, _CURVE,
    )


_LEVELS = f"lv AS (SELECT rank, stat FROM (SELECT stat, row_number() OVER (ORDER BY stat DESC, event_id) AS rank FROM bg) WHERE rank IN {S.FAR_RANKS})"
_FAR = f"SELECT event_id, row_number() OVER (ORDER BY stat DESC, event_id) AS rank, round((row_number() OVER (ORDER BY stat DESC, event_id) - 1) / {MONTH}, 6) AS far FROM "
ORACLES = {
    "trigger_threshold": _sql(f"SELECT event_id, time, stat FROM trig WHERE stat > {LOUD}"),
    "trigger_clusters": _clusters_sql(GAP),
    "trigger_clusters_tight": _clusters_sql(TIGHT),
    "nearest_injection": _sql("SELECT event_id, inj_id, dt FROM m", _MATCH),
    "tp_fp_split": _sql(f"SELECT event_id, coalesce(dt <= {VAR}, false) AS tp FROM m", _MATCH),
    "unmatched_injections": _sql("SELECT inj_id FROM inj WHERE inj_id NOT IN (SELECT inj_id FROM m)", _MATCH),
    "best_true_positive": _sql("SELECT inj_id, stat FROM best", _MATCH),
    "true_missed": _sql("SELECT inj_id FROM inj WHERE inj_id NOT IN (SELECT inj_id FROM best)", _MATCH),
    "background_far": _sql(_FAR + "bg"),
    "foreground_far": _sql(_FAR + f"m WHERE dt > {VAR}", _MATCH),
    "far_levels": _sql("SELECT rank, stat FROM lv", _LEVELS),
    "found_at_level": _sql("SELECT rank, count(*) AS n_found FROM best JOIN lv ON best.stat > lv.stat GROUP BY rank", _MATCH, _LEVELS),
    "found_curve": _sql("SELECT event_id, stat, n, round(m, 3) AS m, round(m2, 1) AS m2 FROM cv", _MATCH, _CURVE),
    "sensitive_volume_plain": _volume_sql(False),
    "sensitive_volume_chirp": _volume_sql(True),
    "efficiency_by_snr": _sql(
        "SELECT snr, count(*) AS n, count(best.inj_id) AS n_found, round(count(best.inj_id) / count(*), 6) AS efficiency FROM inj LEFT JOIN best USING (inj_id) GROUP BY snr", _MATCH
    ),
    "unique_pairs_a_b_both": _sql(
        "SELECT CASE WHEN a < b THEN 'both' WHEN a = 0 THEN 'first' ELSE 'second' END AS side, count(*) AS n FROM (SELECT time // 3600000000 AS h, event_type, min(user_id % 2) AS a, max(user_id % 2) AS b FROM ev GROUP BY 1, 2) GROUP BY 1"
    ),
}
