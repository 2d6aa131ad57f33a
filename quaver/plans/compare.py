"""Queries that compare two teams and false-alarm levels, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.operators import search as S
from quaver.operators import tables as T
from quaver.plans import search as P
from quaver.session import table
from quaver.sources import roles as R

DAYS, MONTH_DAYS, LIVE_DAYS = 30.0, 30.0, 25.0
SMOOTH, BIN = 1e-3, 50


def per_month(far, total: float, month: float, live: float):
    """False alarms of a month from the rate over ``total``, of which ``live`` was observed."""
    return far * F.lit(total) * F.lit(month / live)


def far_per_month(spark, d) -> DataFrame:
    """The curve without its first point, the loudest event."""
    rows = S.false_alarm_rates(R.background(spark, d).select("event_id", "stat"), DAYS).where("rank > 1")
    return rows.select("event_id", "rank", F.round(per_month(F.col("far"), DAYS, MONTH_DAYS, LIVE_DAYS), 6).alias("per_month"))


def _found(spark, d) -> DataFrame:
    return S.best_true_positives(P._matched(spark, d), P.VAR)


def bad_band(spark, d) -> DataFrame:
    """Found between the levels of 1000 and 100 alarms a month, at a middling SNR; none where a level is missing."""
    levels = {r["rank"]: r["stat"] for r in S.far_levels(R.background(spark, d)).collect()}
    low, high = (F.lit(levels.get(k)).cast("double") for k in (1000, 100))
    rows = _found(spark, d).join(R.injections(spark, d).select("inj_id", "snr"), "inj_id")
    return rows.where((F.col("stat") > low) & (F.col("stat") <= high) & (F.col("snr") > 10) & (F.col("snr") < 100)).select("inj_id", "stat", "snr")


def efficiency_by_level(spark, d) -> DataFrame:
    """Share of each SNR's injections found at each of five levels, counted a level at a time in one pass."""
    levels = sorted((r["rank"], r["stat"]) for r in S.far_levels(R.background(spark, d)).collect())
    rows = R.injections(spark, d).select("inj_id", "snr").join(_found(spark, d), "inj_id", "left")
    found = [F.struct(F.lit(rank).cast("long").alias("rank"), F.count(F.when(F.col("stat") > F.lit(level), 1)).alias("n_found")) for rank, level in levels]
    counts = rows.groupBy("snr").agg(F.count("*").alias("_n"), F.array(*found).cast("array<struct<rank:bigint,n_found:bigint>>").alias("_f"))
    return counts.select("snr", "_n", F.inline("_f")).select("snr", "rank", "n_found", F.round(F.col("n_found") / F.col("_n"), 6).alias("efficiency"))


def _sides(spark, d, *columns: str) -> DataFrame:
    """Distinct values of the events of two teams, even and odd users, and the ``side`` that has them."""
    rows = R.events(spark, d).select(F.expr("time div 3600000000").alias("hour"), "event_type", "stat", (F.col("user_id") % 2).alias("team"))
    return T.sides(rows, F.col("team") == 0, F.col("team") == 1, list(columns))


def unique_pairs(spark, d) -> DataFrame:
    """The pairs that only one team has, or both."""
    return _sides(spark, d, "hour", "event_type")


def unique_values(spark, d) -> DataFrame:
    return _sides(spark, d, "hour").where("side = 'first'").select("hour")


def unique_ratio_bins(spark, d) -> DataFrame:
    """By bins of stat, the first team's values that the second lacks for each of the second's that the first lacks, smoothed."""
    own = _sides(spark, d, "stat").where("side <> 'both'")
    n = [F.count(F.when(F.col("side") == side, 1)).alias(f"n_{side}") for side in ("first", "second")]
    rows = own.groupBy(F.floor(F.col("stat") / BIN).cast("long").alias("bin")).agg(*n)
    return rows.withColumn("ratio", F.round((F.col("n_first") + SMOOTH) / (F.col("n_second") + SMOOTH), 6))


def histogram_int_edges(spark, d) -> DataFrame:
    """Counts between 40 whole-number edges, the last bin closed."""
    return T.histogram_of_edges(table(spark, d, "lineitem"), "l_extendedprice", 40)


def head_per_flag(spark, d) -> DataFrame:
    """The first 25 rows of each return flag."""
    return T.first_rows(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], 25)


def best_so_far(spark, d) -> DataFrame:
    """Days as epochs: mean value, the least mean so far, and whether the day set it."""
    days = R.events(spark, d).groupBy(F.expr("time div 86400000000").alias("epoch")).agg(F.round(F.sum(F.col("stat").cast("decimal(28,6)")) / F.count("*"), 4).cast("double").alias("loss"))
    return T.best_so_far(days, "epoch", "loss")


QUERIES = {
    "far_per_month": far_per_month,
    "bad_band": bad_band,
    "efficiency_by_level": efficiency_by_level,
    "unique_pairs": unique_pairs,
    "unique_values": unique_values,
    "unique_ratio_bins": unique_ratio_bins,
    "histogram_int_edges": histogram_int_edges,
    "head_per_flag": head_per_flag,
    "epoch_best_so_far": best_so_far,
}

_TEAMS = "tm AS (SELECT time // 3600000000 AS hour, event_type, user_id % 2 AS team, stat FROM ev)"
_A, _B = "SELECT hour, event_type FROM tm WHERE team = 0", "SELECT hour, event_type FROM tm WHERE team = 1"
ORACLES = {
    "far_per_month": P._sql(
        f"SELECT event_id, rank, round((rank - 1) / {DAYS} * {DAYS} * ({MONTH_DAYS} / {LIVE_DAYS}), 6) AS per_month FROM (SELECT event_id, row_number() OVER (ORDER BY stat DESC, event_id) AS rank FROM bg) WHERE rank > 1"
    ),
    "bad_band": P._sql(
        "SELECT inj_id, best.stat, snr FROM best JOIN inj USING (inj_id) WHERE best.stat > (SELECT stat FROM lv WHERE rank = 1000) AND best.stat <= (SELECT stat FROM lv WHERE rank = 100) AND snr > 10 AND snr < 100",
        P._MATCH, P._LEVELS,
    ),
    "efficiency_by_level": P._sql(
        "SELECT snr, rank, count(*) FILTER (WHERE best.stat > lv.stat) AS n_found, round(count(*) FILTER (WHERE best.stat > lv.stat) / count(*), 6) AS efficiency FROM inj LEFT JOIN best USING (inj_id) CROSS JOIN lv GROUP BY snr, rank",
        P._MATCH, P._LEVELS,
    ),
    "unique_pairs": P._sql(
        f"SELECT 'first' AS side, * FROM ({_A} EXCEPT {_B}) UNION ALL SELECT 'second', * FROM ({_B} EXCEPT {_A}) UNION ALL SELECT 'both', * FROM ({_A} INTERSECT {_B})", _TEAMS
    ),
    "unique_values": P._sql("SELECT hour FROM tm WHERE team = 0 EXCEPT SELECT hour FROM tm WHERE team = 1", _TEAMS),
    "unique_ratio_bins": P._sql(
        f"""SELECT bin, coalesce(n_first, 0) AS n_first, coalesce(n_second, 0) AS n_second, round((coalesce(n_first, 0) + {SMOOTH}) / (coalesce(n_second, 0) + {SMOOTH}), 6) AS ratio
        FROM (SELECT floor(stat / {BIN})::BIGINT AS bin, count(*) AS n_first FROM (SELECT stat FROM tm WHERE team = 0 EXCEPT SELECT stat FROM tm WHERE team = 1) GROUP BY 1)
        FULL JOIN (SELECT floor(stat / {BIN})::BIGINT AS bin, count(*) AS n_second FROM (SELECT stat FROM tm WHERE team = 1 EXCEPT SELECT stat FROM tm WHERE team = 0) GROUP BY 1) USING (bin)""",
        _TEAMS,
    ),
    "histogram_int_edges": """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
e AS (SELECT i, floor(lo + i * ((hi - lo) / 39))::BIGINT AS edge FROM r, range(40) t(i)),
b AS (SELECT i AS bin, edge AS low, lead(edge) OVER (ORDER BY i) AS high FROM e)
SELECT bin::INT AS bin, low, high, count(*) AS n FROM b JOIN lineitem ON l_extendedprice >= low AND (l_extendedprice < high OR bin = 38 AND l_extendedprice <= high)
WHERE high IS NOT NULL GROUP BY 1, 2, 3""",
    "head_per_flag": "SELECT l_returnflag, l_orderkey, l_linenumber, r AS rn FROM (SELECT l_returnflag, l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber))::INT AS r FROM lineitem) WHERE r <= 25",
    "epoch_best_so_far": P._sql(
        "SELECT epoch, loss, min(loss) OVER (ORDER BY epoch) AS best, loss = min(loss) OVER (ORDER BY epoch) AND loss < coalesce(min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS improved FROM (SELECT time // 86400000000 AS epoch, round(sum(stat::DECIMAL(28,6))::DOUBLE / count(*), 4) AS loss FROM ev GROUP BY 1)"
    ),
}
