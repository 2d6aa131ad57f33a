"""Regular series in blocks of samples, and what reads across block borders.

A series is ``det, seg, block, samples``: ``size`` samples a row, the last block of a
segment shorter. What spans blocks is stitched from copies of neighbouring blocks under
the block where it begins, so that a group holds a few blocks, however long a segment
is; no segment is ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.operators import counters
from quaver.operators.ordered import bucketed, numbered_within, running_sums


def blocks_of(samples: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """Blocks of ``det, seg`` series whose samples stand in a row each, in an order; equal places are ordered by value."""
    rows = numbered_within(samples.select("det", "seg", F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")), ["det", "seg"], ["_o", "_v"], "_n")
    rows = rows.select("det", "seg", F.expr(f"(_n - 1) div {size}").alias("block"), F.struct(F.col("_n"), F.col("_v")).alias("_s"))
    rows = rows.groupBy("det", "seg", "block").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    return rows.select("det", "seg", "block", F.col("_s._v").alias("samples"))


def lengths(blocks: DataFrame) -> DataFrame:
    """``det, seg, n``: samples of each series."""
    return blocks.groupBy("det", "seg").agg(F.sum(F.size("samples")).cast("long").alias("n"))


def common_lengths(blocks: DataFrame, detectors: list[str]) -> DataFrame:
    """``seg, n``: samples that all detectors have of each segment; a segment that one of them lacks has none."""
    rows = lengths(blocks).where(F.col("det").isin(detectors)).groupBy("seg").agg(F.min("n").alias("n"), F.count("*").alias("_d"))
    return rows.where(F.col("_d") == len(detectors)).drop("_d")


def hop_plan(sizes: DataFrame, step: int, span: int) -> DataFrame:
    """``seg, windows, first``: windows of ``span`` samples at each ``step``, and the number of the first one.

    As many as ``(n - span) div step``, one fewer than fits. Numbers run over the segments in the order of their keys.
    """
    rows = bucketed(sizes.select("seg", F.greatest(F.lit(0), F.expr(f"(n - {span}) div {step}")).cast("long").alias("windows")), [F.col("seg")])
    rows = running_sums(rows, [F.col("seg")], {"_upto": F.col("windows")})
    return rows.select("seg", "windows", (F.col("_upto") - F.col("windows")).alias("first"))


def locate(indices: DataFrame, plan: DataFrame, index: str = "index") -> DataFrame:
    """Add ``seg, k`` to global window numbers: the segment whose numbers hold it, and its place there.

    Numbers and segments meet in one order of numbers, so that no pair of them is tried; numbers beyond all windows have nulls.
    """
    from quaver.operators.ordered import neighbours

    starts = plan.where("windows > 0").select(F.col("first").alias("_at"), F.lit(0).alias("_kind"), F.struct("seg", "first", "windows").alias("_plan"))
    asked = indices.select(F.col(index).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*indices.columns).alias("_row"))
    order = [F.col("_at"), F.col("_kind")]
    rows = bucketed(starts.unionByName(asked, allowMissingColumns=True), order)
    rows = neighbours(rows, order, {"_p": F.col("_plan")}).where("_kind = 1")
    inside = F.col("_at") < F.col("_p.first") + F.col("_p.windows")
    return rows.select("_row.*", F.when(inside, F.col("_p.seg")).alias("seg"), F.when(inside, F.col("_at") - F.col("_p.first")).alias("k"))


def stitched(blocks: DataFrame, detectors: list[str], size: int, reach: int) -> DataFrame:
    """``seg, block`` and for each detector the samples from the block's first on, ``size + reach`` at most.

    Each block is copied to the ``ceil(reach / size)`` blocks before it.
    """
    back = -(-reach // size)
    rows = blocks.where(F.col("det").isin(detectors)).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(back).cast("long"), F.col("block")))))
    rows = rows.select("seg", (F.col("block") - F.col("_j")).alias("block"), F.struct("_j", "samples").alias("_part"), "det")
    parts = [F.array_sort(F.collect_list(F.when(F.col("det") == d, F.col("_part")))).alias(d) for d in detectors]
    rows = rows.groupBy("seg", "block").agg(*parts)
    # A block that stands here only as the one before another has no samples of its own and begins nothing.
    rows = rows.where(F.exists(detectors[0], lambda p: p["_j"] == 0))
    return rows.select("seg", "block", *[F.slice(F.flatten(F.col(d)["samples"]), 1, size + reach).alias(d) for d in detectors])


def windows(blocks: DataFrame, detectors: list[str], size: int, step: int, span: int) -> DataFrame:
    """``index, seg, k`` and ``span`` samples of each detector, for all windows of ``hop_plan``."""
    plan = hop_plan(common_lengths(blocks, detectors), step, span)
    rows = stitched(blocks, detectors, size, span - 1).join(plan, "seg")
    first, last = F.expr(f"(block * {size} + {step - 1}) div {step}"), F.expr(f"least(windows - 1, ((block + 1) * {size} - 1) div {step})")
    rows = rows.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    at = (F.col("k") * step - F.col("block") * size + 1).cast("int")
    return rows.select((F.col("first") + F.col("k")).alias("index"), "seg", "k", *[F.slice(d, at, span).alias(d) for d in detectors])


def scored(rows: DataFrame, scorer: Callable[[dict[str, np.ndarray]], np.ndarray], arrays: list[str], name: str = "raw") -> DataFrame:
    """Add a model's output: ``scorer`` takes a matrix for each array column, a row a window, and returns a value a row."""
    kept = [c for c in rows.columns if c not in arrays]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                values = scorer({a: np.stack(frame[a].to_numpy()) for a in arrays})
                yield frame[kept].assign(**{name: np.asarray(values, dtype=float)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInPandas(run, f"{schema}, {name} double")


#: How many draws of its own each mode gives: detectors are numbered in order.
MODES = {
    "first_and_rest": lambda i: min(i, 1),
    "all": lambda i: i,
    "all_but_first": lambda i: None if i == 0 else i,
    "none": lambda i: None,
}


def slide_plan(extents: DataFrame, detectors: list[str], mode: str, seed: int, duration: int | None = None) -> DataFrame:
    """Where each detector's slice begins: ``det, seg, n, begin`` of ``det, seg, start, n`` series, in samples.

    All detectors give the samples of their common span, or ``duration`` of them from its
    start. A shift moves a slice within its own series, drawn by the segment's key; detectors of
    one draw share a shift that fits all of them. Where nothing is free, the shift is 0. A
    segment that a detector lacks, or whose common span is shorter than ``duration`` or empty, has no slices.
    """
    numbers = F.coalesce(*[F.when(F.col("det") == d, F.lit(i)) for i, d in enumerate(detectors)])
    rows = extents.withColumn("_i", numbers).where("_i is not null")
    spans = rows.groupBy("seg").agg(F.max("start").alias("_s"), F.min(F.col("start") + F.col("n")).alias("_e"), F.count("*").alias("_d"))
    spans = spans.where(F.col("_d") == len(detectors)).withColumn("_n", F.col("_e") - F.col("_s") if duration is None else F.lit(duration).cast("long"))
    spans = spans.where("_n > 0 and _n <= _e - _s")
    rows = rows.join(spans, "seg").withColumn("_at", F.col("_s") - F.col("start"))
    groups = {i: MODES[mode](i) for i in range(len(detectors))}
    group = F.coalesce(*[F.when(F.col("_i") == i, F.lit(g)) for i, g in groups.items() if g is not None], F.lit(-1))
    # The free range that all detectors of a draw have.
    free = rows.select("seg", group.alias("_g"), (-F.col("_at")).alias("_low"), (F.col("n") - F.col("_at") - F.col("_n")).alias("_high"))
    free = free.groupBy("seg", "_g").agg(F.max("_low").alias("_low"), F.min("_high").alias("_high"))
    drawn = F.coalesce(*[F.when(F.col("_g") == g, counters.whole(F.col("seg"), seed, F.col("_high") - F.col("_low"), stream=g)) for g in sorted({g for g in groups.values() if g is not None})], F.lit(0))
    shift = F.when((F.col("_g") < 0) | (F.col("_low") >= F.col("_high")), F.lit(0)).otherwise(F.col("_low") + drawn).cast("long")
    rows = rows.withColumn("_g", group).join(free.select("seg", "_g", shift.alias("_shift")), ["seg", "_g"])
    return rows.select("det", "seg", F.col("_n").alias("n"), (F.col("_at") + F.col("_shift")).alias("begin"))


def cut(blocks: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """New blocks of the samples ``begin`` to ``begin + n - 1`` of each series: a block gives to two new ones at most."""
    rows = blocks.join(plan, ["det", "seg"]).withColumn("_at", F.col("block") * size - F.col("begin"))
    rows = rows.withColumns({"_a": F.greatest(F.lit(0), F.col("_at")), "_b": F.least("n", F.col("_at") + F.size("samples"))}).where("_a < _b")
    rows = rows.withColumn("_to", F.explode(F.sequence(F.expr(f"_a div {size}"), F.expr(f"(_b - 1) div {size}"))))
    a, b = F.greatest("_a", F.col("_to") * size), F.least("_b", (F.col("_to") + 1) * size)
    part = F.slice("samples", (a - F.col("_at") + 1).cast("int"), (b - a).cast("int"))
    rows = rows.select("det", "seg", F.col("_to").alias("block"), F.struct(a.alias("a"), part.alias("part")).alias("_part"))
    rows = rows.groupBy("det", "seg", "block").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return rows.select("det", "seg", "block", F.flatten("_parts.part").alias("samples"))


def aligned(blocks: DataFrame, detectors: list[str]) -> DataFrame:
    """``seg, block`` with an array for each detector, for blocks that all detectors have."""
    rows = blocks.where(F.col("det").isin(detectors)).groupBy("seg", "block")
    rows = rows.agg(*[F.first(F.when(F.col("det") == d, F.col("samples")), ignorenulls=True).alias(d) for d in detectors])
    return rows.dropna(subset=detectors)


def shifted_injections(injections: DataFrame, segments: DataFrame, padding_start: int, padding_end: int) -> DataFrame:
    """Place injections that count time from 0 into disjoint segments laid end to end.

    ``inj_id, tc`` and ``seg_id, start, end`` to ``inj_id, seg_id, tc``. A segment takes the
    injections of its stretch of the summed lengths, moved by its start less the lengths before, plus the
    padding; what falls outside its padded span is left out, and so may one injection be in two segments.
    """
    from quaver.operators.intervals import offsets
    from quaver.operators.ordered import neighbours

    laid = offsets(segments).select("seg_id", "start", "end", "offset")
    # In summed time a segment takes [offset, offset + length - both paddings], ends included; one after another, never two at once.
    laid = laid.withColumn("_last", F.col("offset") + F.col("end") - F.col("start") - padding_start - padding_end).where("_last >= offset")
    starts = laid.select(F.col("offset").alias("_at"), F.lit(0).alias("_kind"), F.struct("seg_id", "start", "offset", "_last").alias("_seg"))
    asked = injections.where("tc is not null").select(F.col("tc").alias("_at"), F.lit(1).alias("_kind"), F.struct("inj_id", "tc").alias("_inj"))
    order = [F.col("_at"), F.col("_kind"), F.col("_seg.seg_id")]
    rows = neighbours(bucketed(starts.unionByName(asked, allowMissingColumns=True), order), order, {"_s": F.col("_seg")}).where("_kind = 1")
    first = rows.where("_at <= _s._last").select("_inj", "_s")
    # Without padding the last moment of a segment is the first of the next; its injection is in both.
    ends = laid.select(F.col("_last").alias("_at"), F.struct("seg_id", "start", "offset", "_last").alias("_e"))
    both = rows.where("_at = _s.offset").join(ends, "_at").where("_e.seg_id <> _s.seg_id").select("_inj", F.col("_e").alias("_s"))
    out = first.unionByName(both)
    return out.select("_inj.inj_id", "_s.seg_id", (F.col("_inj.tc") - F.col("_s.offset") + F.col("_s.start") + padding_start).alias("tc"))


def time_of(index: Column, t0: Column, step: int, tick: int, peak: int) -> Column:
    """When a window's expected peak is: the segment's start, its hops, and the peak's place, in whole units of time."""
    return t0 + index * F.lit(step * tick) + F.lit(peak)
