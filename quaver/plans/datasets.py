"""Queries that build data sets: drawn noise, curated segments, ratios of injections, shards with a lookup table; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import signal as S
from quaver.operators import counters as K
from quaver.operators import draws
from quaver.operators import intervals as I
from quaver.operators import samples as M
from quaver.operators import series as W
from quaver.plans import spans
from quaver.plans.spectra import _list, _sums
from quaver.plans.training import _PAIRS, _ends, _pairs, _tell
from quaver.session import new_path
from quaver.sinks import dataset as sinks
from quaver.sources import files as sources
from quaver.sources import roles as R

SEED, LENGTH, SHARD, RATE = 91, 30, 25, 32.0
PSD = [1 + (k / 4) ** 2 for k in range(17)]


def noise_slices(spark, d):
    """A stretch of noise for each injection: a detector's segment, likelier the longer it is, and a place in it."""
    blocks, out = R.strain(spark, d), None
    for i, det in enumerate(R.DETECTORS):
        sizes = W.lengths(blocks).where(F.col("det") == det).select(F.col("seg").alias("seg_id"), F.lit(0).cast("long").alias("start"), (F.col("n") - LENGTH).alias("end"))
        picked = draws.by_duration(R.injections(spark, d).select("inj_id"), "inj_id", sizes, SEED + i)
        manifest = picked.select(F.concat_ws("/", "inj_id", F.lit(det)).alias("sample_id"), F.lit(det).alias("det"), F.col("seg_id").alias("seg"), F.col("at_second").alias("begin"), F.lit(LENGTH).alias("n"))
        out = manifest if out is None else out.unionByName(manifest)
    got = M.gathered(out, blocks, R.BLOCK)
    return got.select("sample_id", "seg", "begin", F.size("samples").alias("n"), *_tell("samples"))


def curated_noise(spark, d):
    """What is left of observing ranges around known events, and for each piece whether an event is inside after all."""
    pieces = I.subtract(spans._hours(spark, d), spans._vetoes(spark, d), 60 * R.SECOND).withColumn("seg_id", F.col("start"))
    hit = I.holding(pieces, R.injections(spark, d).select("tc"), "tc").select("seg_id", F.lit(True).alias("hit"))
    return pieces.join(hit, "seg_id", "left").select("start", "end", F.coalesce("hit", F.lit(False)).alias("hit"))


def injection_snr(spark, d):
    """The optimal ratio of each signal in each detector, and in both together."""
    optimal = S.column_of(S.sigma2, PSD, 1.0, RATE, 2.0)
    rows = _pairs(spark, d).where("target = 1").select("vec_id", *[optimal(det)[0].alias(det) for det in R.DETECTORS])
    return rows.select("vec_id", *[F.round(F.sqrt(det), 6).alias(f"snr_{det}") for det in R.DETECTORS], F.round(F.sqrt(F.col("H1") + F.col("L1")), 6).alias("network"))


def dataset_build(spark, d):
    """Shards of samples by class, written with a lookup table, and each row of the table found again where it points."""
    path = new_path(spark, "dataset")
    sinks.write_dataset(_pairs(spark, d), path, "vec_id", "target", SHARD, SEED, keep=("batch",))
    lookup = sources.read_lookup(spark, path)
    found = sources.read_samples(spark, path, lookup)
    return found.select("id", "path", "row", "target", "batch", *_tell("H1", "L1"))


QUERIES = {"noise_slices": noise_slices, "curated_noise": curated_noise, "injection_snr": injection_snr, "dataset_build": dataset_build}


def _sql(select: str, *parts: str) -> str:
    return f"WITH {','.join([R.SQL, R.STRAIN, *parts])} {select}"


def _slices_sql() -> str:
    parts = []
    for i, det in enumerate(R.DETECTORS):
        laid = f"(SELECT seg, n - {LENGTH} AS len, sum(n - {LENGTH}) OVER (ORDER BY seg) AS upto, sum(n - {LENGTH}) OVER () AS total FROM ln WHERE det = '{det}' AND n > {LENGTH})"
        drawn = f"(SELECT inj_id, floor({K.uniform_sql('inj_id', SEED + i)} * (SELECT sum(n - {LENGTH}) FROM ln WHERE det = '{det}' AND n > {LENGTH}))::BIGINT AS place FROM inj)"
        parts.append(f"SELECT inj_id, '{det}' AS det, seg, floor({K.uniform_sql('inj_id', SEED + i, 1)} * len)::BIGINT AS b FROM {drawn} JOIN {laid} ON place < upto AND place >= upto - len")
    picked = " UNION ALL ".join(parts)
    return _sql(
        f"""SELECT inj_id || '/' || m.det AS sample_id, m.seg, b AS begin, count(pos)::INT AS n, arg_min(v, pos) AS samples_first, arg_max(v, pos) AS samples_last
        FROM ({picked}) m LEFT JOIN smp s ON s.det = m.det AND s.seg = m.seg AND pos BETWEEN b AND b + {LENGTH - 1} GROUP BY ALL"""
    )


def _snr_sql() -> str:
    part = lambda k: f"4 * 1.0 * list_sum(list_transform(range(2, 16), lambda k: (re[k + 1] * re[k + 1] + im[k + 1] * im[k + 1]) / {RATE**2} / {_list(PSD)}[k + 1]))"
    sides = [f"{name} AS (SELECT vec_id, {part(0)} AS v FROM ({_sums('x', 'pr', array, 32, 'vec_id')[len('x AS (') : -1]} WHERE target = 1))" for name, array in (("sh", "h"), ("sl", "l"))]
    return f"WITH {_PAIRS}, {', '.join(sides)} SELECT vec_id, round(sqrt(sh.v), 6) AS \"snr_H1\", round(sqrt(sl.v), 6) AS \"snr_L1\", round(sqrt(sh.v + sl.v), 6) AS network FROM sh JOIN sl USING (vec_id)"


ORACLES = {
    "noise_slices": _slices_sql(),
    "curated_noise": f'SELECT start, "end", EXISTS (SELECT 1 FROM ({_sql("SELECT tc FROM inj")}) i WHERE i.tc BETWEEN start AND "end") AS hit FROM ({spans.ORACLES["interval_subtract"]})',
    "injection_snr": _snr_sql(),
    "dataset_build": f"""WITH {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {K.draw_sql('vec_id', SEED)}, vec_id) - 1 AS r FROM pr)
        SELECT vec_id AS id, 'class=' || target || '/shard=' || (r // {SHARD}) AS path, r % {SHARD} AS row, target, batch, {_ends('h', 'h1')}, {_ends('l', 'l1')} FROM n""",
}
