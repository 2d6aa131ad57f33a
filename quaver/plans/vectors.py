"""Queries over sample arrays: native kernels with SQL, spectral kernels against NumPy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import arrays as V
from quaver.operators.quantiles import quantiles
from quaver.session import table


def _samples(spark, d):
    rows = table(spark, d, "embeddings").where("embedding is not null")
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))


def _rows(df, digits: int = 6):
    # Zero has one sign.
    return V.per_position(df, "a").select("vec_id", "pos", (F.round("v", digits) + F.lit(0.0)).alias("v"))


def _psd(spark, d):
    return _samples(spark, d).select("vec_id", "label", F.transform("a", lambda x: x * x).alias("a"))


def _by_label(spark, d, how):
    return V.per_position(_psd(spark, d), "a").groupBy("label", "pos").agg(F.round(how("v"), 9).alias("v"))


def _median(spark, d):
    """The median over a label's PSDs at each frequency."""
    return quantiles(V.per_position(_psd(spark, d), "a"), ["label", "pos"], "v", [0.5]).select("label", "pos", "v")


def blackout_psd(spark, d):
    """Bins far above their label's median; one array of medians a label."""
    arrays = _median(spark, d).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("m"))
    rows = _psd(spark, d).join(arrays, "label")
    muted = F.size(F.filter(V.blackout(F.col("a"), F.col("m"), 8.0), lambda x: x == 999_999_999_999.0))
    return rows.select("vec_id", muted.alias("n_muted"))


def network_snr(spark, d):
    """Root of the summed squares of pairs of detectors (even and next id)."""
    power = F.aggregate("a", F.lit(0.0), lambda t, x: t + x * x)
    rows = _samples(spark, d).select(F.expr("vec_id div 2").alias("pair"), power.alias("s"))
    return rows.groupBy("pair").agg(F.round(F.sqrt(F.sum("s")), 6).alias("snr"))


QUERIES = {
    "array_normalise": lambda s, d: _rows(_samples(s, d).select("vec_id", V.normalise(F.col("a")).alias("a"))),
    "array_crop": lambda s, d: _rows(_samples(s, d).select("vec_id", V.crop(F.col("a"), 5, 9).alias("a"))),
    "cyclic_shift": lambda s, d: _rows(_samples(s, d).select("vec_id", V.cyclic_shift(F.col("a"), 11).alias("a"))),
    "zero_pad": lambda s, d: _rows(_samples(s, d).select("vec_id", V.zero_pad(F.col("a"), 3, 80).alias("a"))),
    "sinusoid": lambda s, d: _rows(_samples(s, d).select("vec_id", V.sinusoid(1 + F.col("vec_id") % 20, F.lit(0.25), 64, 128.0).alias("a"))),
    "median_psd": lambda s, d: _median(s, d).withColumn("v", F.round("v", 9)),
    "max_psd": lambda s, d: _by_label(s, d, F.max),
    "blackout_psd": blackout_psd,
    "band_integral": lambda s, d: _psd(s, d).select("vec_id", F.round(V.band_integral(F.col("a"), 8, 31, 0.25), 6).alias("v")),
    "worst_psd_topn": lambda s, d: _psd(s, d).select("vec_id", F.array_max("a").alias("peak")).orderBy(F.desc("peak"), "vec_id").limit(16),
    "network_snr": network_snr,
}

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS a FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT vec_id, label, list_transform(a, lambda x: x * x) AS a FROM e)"
_PX = f"WITH {_E}, x AS (SELECT vec_id, label, unnest(range(len(a))) AS pos, unnest(a) AS v FROM p)"


def _positions(array: str) -> str:
    return f"WITH {_E}, o AS (SELECT vec_id, {array} AS b FROM e) SELECT vec_id, unnest(range(len(b)))::INT AS pos, round(unnest(b), 6) + 0.0 AS v FROM o"


ORACLES = {
    "array_normalise": _positions("list_transform(a, lambda x: (x - list_min(a)) / (list_max(a) - list_min(a)) - (list_avg(a) - list_min(a)) / (list_max(a) - list_min(a)))"),
    "array_crop": _positions("a[6 : len(a) - 9]"),
    "cyclic_shift": _positions("a[len(a) - 10 : len(a)] || a[1 : len(a) - 11]"),
    "zero_pad": _positions("[0.0, 0.0, 0.0]::DOUBLE[] || a || list_transform(range(80 - 3 - len(a)), lambda i: 0.0::DOUBLE)"),
    "sinusoid": _positions("list_transform(range(64), lambda i: sin(2 * pi() / 128 * (1 + vec_id % 20) * i + 0.25))"),
    "median_psd": _PX + " SELECT label, pos::INT AS pos, round(quantile_cont(v, 0.5), 9) AS v FROM x GROUP BY 1, 2",
    "max_psd": _PX + " SELECT label, pos::INT AS pos, round(max(v), 9) AS v FROM x GROUP BY 1, 2",
    "blackout_psd": _PX + ", m AS (SELECT label, pos, quantile_cont(v, 0.5) AS md FROM x GROUP BY 1, 2) SELECT vec_id, count(*) FILTER (WHERE v > md * 8.0)::INT AS n_muted FROM x JOIN m USING (label, pos) GROUP BY vec_id",
    "band_integral": f"WITH {_E} SELECT vec_id, round((list_sum(a[9 : 32]) - (a[9] + a[32]) / 2) * 0.25, 6) AS v FROM p",
    "worst_psd_topn": f"WITH {_E} SELECT vec_id, list_max(a) AS peak FROM p ORDER BY peak DESC, vec_id LIMIT 16",
    "network_snr": f"WITH {_E} SELECT vec_id // 2 AS pair, round(sqrt(sum(list_sum(a))), 6) AS snr FROM p GROUP BY 1",
}
