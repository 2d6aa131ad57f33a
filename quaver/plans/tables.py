"""Queries of histograms, curves, weights, splits and parameters, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quaver.functions import astro as A
from quaver.operators import counters as K
from quaver.operators import tables as T
from quaver.operators.quantiles import quantiles
from quaver.session import table
from quaver.sources import roles as R


def _scores(spark, d):
    """A classifier's output: a text's length as the score of its quality label."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("target"))
    return docs.where("score is not null").join(labels, "doc_id")


_SCORES = "sc AS (SELECT d.doc_id, n_chars::DOUBLE AS score, quality AS target FROM documents d JOIN labels l USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)"


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"))


_LINES = "li AS (SELECT *, l_orderkey * 8 + l_linenumber AS row_id FROM lineitem)"


def accuracy(spark, d):
    """Share of predictions at 0.5 that are right; exactly 0.5 rounds to even."""
    rows = _scores(spark, d).withColumn("p", F.least(F.lit(1.0), F.col("score") / 2000))
    return rows.agg(F.round(F.avg((F.bround("p", 0) == F.col("target")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def detection_fraction(spark, d):
    """For each noise score, the share of signals strictly above it."""
    rows = T.roc(_scores(spark, d)).where("q > 0")
    positives = _scores(spark, d).where("target = 1").count()
    return rows.select("score", F.round((F.col("tp") - F.col("p")) / F.lit(positives or None), 9).alias("fraction"))


def mode_choice(spark, d):
    """One of four modes by cumulative probabilities 0.1, 0.3, 0.6, 1."""
    u = K.draw(F.col("event_id"), 1)
    edges = [int(p * K.RANGE) for p in (0.1, 0.3, 0.6)]
    mode = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return R.events(spark, d).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def percentiles(spark, d):
    rows = quantiles(_lines(spark, d), [], "l_extendedprice", [p / 100 for p in (5, 50, 95)])
    return rows.agg(*[F.round(F.max(F.when(F.col("q") == p / 100, F.col("v"))), 4).alias(f"p{p}") for p in (5, 50, 95)])


def _masses(spark, d):
    return R.injections(spark, d)


def _params(spark, d):
    mc = F.col("mc")
    tau = A.duration(mc)
    return _masses(spark, d).select(
        "inj_id", F.round(mc, 6).alias("mc"), F.round(tau, 6).alias("tau"), F.round(A.chirp_mass_of_duration(tau), 6).alias("mc_back"),
        F.round(A.distance(F.col("chirp_distance"), mc), 6).alias("distance"),
        F.round(A.chirp_distance(A.distance(F.col("chirp_distance"), mc), mc), 6).alias("chirp_distance_back"),
        F.round(A.isco_frequency(F.col("mass1"), F.col("mass2")), 6).alias("f_isco"),
        F.round(A.normalised(F.col("mass1"), 7.0, 50.0), 6).alias("norm_mass1"),
    )


QUERIES = {
    "histogram_equal": lambda s, d: T.histogram(_lines(s, d), "l_extendedprice", 40),
    "roc_points": lambda s, d: T.roc(_scores(s, d)).select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr")),
    "roc_auc": lambda s, d: T.roc_auc(_scores(s, d)).select(F.round("auc", 6).alias("auc")),
    "accuracy_banker": accuracy,
    "detection_fraction": detection_fraction,
    "class_balance": lambda s, d: _scores(s, d).agg(F.round(F.avg("target"), 6).alias("share"), F.count("*").alias("n")),
    "inverse_weights": lambda s, d: T.inverse_weights(_lines(s, d), "l_quantity", 8.0).withColumn("weight", F.round("weight", 6)),
    "rolling_mean_500": lambda s, d: T.rolling_mean(R.events(s, d), "time", "stat", 500, 10).withColumn("mean", F.round("mean", 5)),
    "percentiles": percentiles,
    "timing_mean_std": lambda s, d: _lines(s, d).groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("std")),
    "stratified_split": lambda s, d: T.stratified_split(_lines(s, d), "row_id", "l_returnflag", 0.8),
    "ntile_chunks": lambda s, d: T.chunks(_lines(s, d), "row_id", 7),
    "mode_choice": mode_choice,
    "parameter_roundtrips": _params,
}

_H1, _H42 = K.draw_sql("event_id", 1), K.draw_sql("row_id", 42)
_EDGES = [int(p * K.RANGE) for p in (0.1, 0.3, 0.6)]
_SCALE = 5 * (8 * math.pi * 20.0) ** (-8 / 3)
_SUN = A.SUN * A.G / A.C**3
_REF = A.REFERENCE_MASS / 2**0.2
_ROC = """by_ AS (SELECT score, sum(target) AS p, sum(1 - target) AS q FROM sc GROUP BY score),
rc AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM by_)"""
ORACLES = {
    "histogram_equal": """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
        SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM lineitem, r WHERE l_extendedprice IS NOT NULL GROUP BY 1""",
    "roc_points": f"WITH {_SCORES}, {_ROC} SELECT score, round(tp / np, 9) AS tpr, round(fp / nq, 9) AS fpr FROM rc",
    "roc_auc": f"WITH {_SCORES}, {_ROC} SELECT round(sum(q * (2 * tp - p))::DOUBLE / (2.0 * max(np) * max(nq)), 6) AS auc FROM rc",
    "accuracy_banker": f"WITH {_SCORES} SELECT round(avg((round_even(least(1.0, score / 2000), 0) = target)::INT), 6) AS accuracy, count(*) AS n FROM sc",
    "detection_fraction": f"WITH {_SCORES}, {_ROC} SELECT score, round((tp - p) / np, 9) AS fraction FROM rc WHERE q > 0",
    "class_balance": f"WITH {_SCORES} SELECT round(avg(target), 6) AS share, count(*) AS n FROM sc",
    "inverse_weights": "WITH b AS (SELECT floor(l_quantity / 8)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin, n, round((SELECT sum(n) FROM b) / (n * (SELECT count(*) FROM b)), 6) AS weight FROM b",
    "rolling_mean_500": f"""WITH {R.SQL}, w AS (SELECT row_number() OVER (ORDER BY time) AS rn, sum(stat::DECIMAL(28,6)) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND 499 FOLLOWING)::DOUBLE
        / count(*) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND 499 FOLLOWING) AS mean FROM ev) SELECT rn, round(mean, 5) AS mean FROM w WHERE (rn - 1) % 10 = 0""",
    "percentiles": "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) AS p{p}" for p in (5, 50, 95)) + " FROM lineitem",
    "timing_mean_std": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1",
    "stratified_split": f"""WITH {_LINES} SELECT row_id, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_H42}, row_id)
        <= floor(count(*) OVER (PARTITION BY l_returnflag) * 0.8::DOUBLE) AS training FROM li""",
    "ntile_chunks": f"WITH {_LINES} SELECT row_id, ntile(7) OVER (ORDER BY row_id)::INT AS chunk FROM li",
    "mode_choice": f"WITH {R.SQL} SELECT " + " + ".join(f"({_H1} >= {e})::INT" for e in _EDGES) + " AS mode, count(*) AS n FROM ev GROUP BY 1",
    "parameter_roundtrips": f"""WITH {R.SQL} SELECT inj_id, round(mc, 6) AS mc, round({_SCALE} * pow(mc * {_SUN}, -5.0 / 3), 6) AS tau, round(mc, 6) AS mc_back,
        round(chirp_distance * pow(mc / {_REF}, 5.0 / 6), 6) AS distance, round(chirp_distance, 6) AS chirp_distance_back,
        round(1 / ({6**1.5 * math.pi * A.MTSUN} * (mass1 + mass2)), 6) AS f_isco, round((mass1 - 7) / 43, 6) AS norm_mass1 FROM inj""",
}
