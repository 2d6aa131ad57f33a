"""Queries of spectral kernels, filters and noise, and their SQL: discrete sums and step-by-step recurrences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quaver.functions import filters, multirate
from quaver.functions import signal as K
from quaver.operators import counters, noise, series
from quaver.plans.vectors import _rows, _samples
from quaver.session import table
from quaver.sources import roles as R

#: Series of N samples at RATE: every vector is one.
N, RATE, SEGMENT, TAPS, LOW = 64, 64.0, 16, 16, 3.0
#: Densities at bins of two hertz, to whiten with and to colour with.
PSD, OTHER = [(1 + (k / 4) ** 2) for k in range(17)], [2 + np.cos(k / 3) for k in range(17)]
BAND, HIGH = filters.butterworth(2, RATE, 4.0, 24.0), filters.butterworth(3, RATE, low=5.0)
PARTS, TRIM = [(0, 32, 32.0), (32, 64, 64.0)], (2, 3)
SEED, RECOLOURED, ANGLE = 31, 0.7, 0.5
COLOUR = {"H1": noise.taps_of(1 / np.sqrt(np.array(PSD)), 9), "L1": noise.taps_of(np.sqrt(np.array(OTHER)), 9)}
SCALE = float(np.sqrt(RATE / 2))


def _kernel(kernel, *args):
    return lambda spark, d: _rows(_samples(spark, d).select("vec_id", K.column_of(kernel, *args)("a").alias("a")))


def recolour(spark, d):
    """Series that a coin picks are coloured anew, the others only cut to the same length."""
    chosen = counters.coin(F.col("vec_id"), SEED, RECOLOURED)
    made = K.column_of(K.recolour, np.array(OTHER), 2.0, RATE, SEGMENT, TAPS, LOW)(F.when(chosen, F.col("a")))
    return _rows(_samples(spark, d).select("vec_id", F.coalesce(made, F.slice("a", TAPS // 2 + 1, N - TAPS)).alias("a")))


def white_noise(spark, d):
    """A normal draw of each event and detector."""
    draws = [F.round(counters.normal(F.col("event_id"), SEED, i), 6).alias(c) for i, c in enumerate(("h1", "l1"))]
    return table(spark, d, "events").where("event_id is not null").select("event_id", *draws)


def coloured_noise(spark, d):
    """Noise as long as each series of strain, through each detector's filter."""
    rows = noise.noise(R.extents(R.strain(spark, d)), R.BLOCK, SEED, COLOUR, SCALE)
    return rows.select("det", "seg", F.posexplode("samples").alias("p", "v"), "block").select("det", "seg", (F.col("block") * R.BLOCK + F.col("p")).alias("pos"), F.round("v", 6).alias("v"))


def psd_bank(spark, d):
    """Welch densities of each detector's blocks, averaged over consecutive chunks; a last chunk that is not full is left out."""
    rows = R.strain(spark, d).where(F.size("samples") == R.BLOCK)
    rows = rows.select("det", "seg", F.expr("block div 4").alias("chunk"), K.column_of(K.welch, RATE, SEGMENT)("samples").alias("psd"))
    rows = rows.select("det", "seg", "chunk", F.posexplode("psd").alias("k", "v")).groupBy("det", "seg", "chunk", "k").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return rows.where("n = 4").select("det", "seg", "chunk", "k", F.round("v", 4).alias("v"))


QUERIES = {
    "whiten": _kernel(K.whiten, np.array(PSD), 2.0, RATE, TAPS, LOW),
    "welch": _kernel(K.welch, RATE, SEGMENT),
    "recolour": recolour,
    "phase_rotate": _kernel(K.rotate_phase, ANGLE),
    "resample": _kernel(K.resample, 48),
    "optimal_snr": _kernel(K.sigma2, np.array(PSD), 2.0, RATE, LOW),
    "band_pass": _kernel(filters.zero_phase, BAND),
    "high_pass": _kernel(filters.zero_phase, HIGH),
    "monorate": _kernel(filters.decimate, 4),
    "multirate": _kernel(multirate.sample, PARTS, RATE, TRIM),
    "white_noise": white_noise,
    "coloured_noise": coloured_noise,
    "psd_bank": psd_bank,
}

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings WHERE embedding IS NOT NULL)"
_PI2 = repr(2 * np.pi)


def _list(values) -> str:
    return "([" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[])"


def _sums(name: str, source: str, x: str, n: int, keep: str) -> str:
    """Real and imaginary parts of a list's spectrum up to half the rate."""
    part = lambda f, sign: f"list_transform(range({n // 2 + 1}), lambda k: {sign}list_sum(list_transform(range({n}), lambda i: {x}[i + 1] * {f}({_PI2} * ((k * i) % {n}) / {n}))))"
    return f"{name} AS (SELECT {keep}, {part('cos', '')} AS re, {part('sin', '-')} AS im FROM {source})"


def _back(re: str, im: str, n: int, half: bool = True) -> str:
    """A real list of n values from its spectrum; ``half``: the last bin stands for both signs."""
    last = n // 2 if n % 2 == 0 and half else n // 2 + 1
    wave = f"2 * list_sum(list_transform(range(1, {last}), lambda k: ({re})[k + 1] * cos({_PI2} * ((k * i) % {n}) / {n}) - ({im})[k + 1] * sin({_PI2} * ((k * i) % {n}) / {n})))"
    ends = f"({re})[1]" + (f" + (CASE i % 2 WHEN 0 THEN 1 ELSE -1 END) * ({re})[{n // 2 + 1}]" if last == n // 2 else "")
    return f"list_transform(range({n}), lambda i: ({ends} + {wave}) / {n})"


def _unnested(array: str, source: str) -> str:
    return f"SELECT vec_id, unnest(range(len(b)))::INT AS pos, round(unnest(b), 6) + 0.0 AS v FROM (SELECT vec_id, {array} AS b FROM {source})"


def _zero_phase(sections: np.ndarray, source: str, tag: str, n: int = N) -> tuple[list[str], str]:
    """Steps of a forward and a backward run, a sample after the other; the last step's name."""
    pad, rest, parts = filters.padding(sections, n), filters.at_rest(sections), []
    mirrored = f"list_transform(range({pad}), lambda i: 2 * a[1] - a[{pad} - i + 1]) || a || list_transform(range({pad}), lambda i: 2 * a[{n}] - a[{n} - 1 - i])"
    parts.append(f"{tag}0 AS (SELECT vec_id, b, b[1] AS x0 FROM (SELECT vec_id, {mirrored} AS b FROM {source}))")
    at = 0
    for _ in range(2):
        for (b0, b1, b2, _one, a1, a2), (z1, z2) in zip(sections.tolist(), rest.tolist()):
            y = f"({b0!r} * v[1] + s[1])"
            step = f"lambda s, v: [{b1!r} * v[1] - {a1!r} * {y} + s[2], {b2!r} * v[1] - {a2!r} * {y}] || s[3:] || [{y}]"
            parts.append(f"{tag}{at + 1} AS (SELECT vec_id, list_reduce([[{z1!r} * x0, {z2!r} * x0]] || list_transform(b, lambda v: [v]), {step})[3:] AS b, x0 FROM {tag}{at})")
            at += 1
        parts.append(f"{tag}{at + 1} AS (SELECT vec_id, list_reverse(b) AS b, b[len(b)] AS x0 FROM {tag}{at})")
        at += 1
    parts.append(f"{tag}_end AS (SELECT vec_id, b[{pad + 1} : {pad + n}] AS a FROM {tag}{at})")
    return parts, f"{tag}_end"


def _every(q: int) -> tuple[list[str], str]:
    order, ripple, edge = filters.DECIMATION
    steps, last = _zero_phase(filters.chebyshev(order, ripple, edge / q), "e", f"d{q}_")
    return [*steps, f"slow{q} AS (SELECT vec_id, list_transform(range(0, {N}, {q}), lambda i: a[i + 1]) AS a FROM {last})"], f"slow{q}"


def _with(select: str, *parts: str) -> str:
    return f"WITH {_E}, {', '.join(parts)} {select}"


def _level(psd) -> np.ndarray:
    return K.truncated(K.interpolated(np.array(psd), 2.0, 1.0), 1.0, TAPS, LOW)[0]


def _filtered(sections: np.ndarray, tag: str) -> str:
    steps, last = _zero_phase(sections, "e", tag)
    return _with(_unnested("a", last), *steps)


_WINDOW = f"(0.5 - 0.5 * cos({_PI2} * i / {SEGMENT}))"
_BIAS = 1 + sum(1 / (2 * i + 1) - 1 / (2 * i) for i in range(1, (2 * N // SEGMENT - 2) // 2 + 1))


def _welch(source: str, key: str) -> list[str]:
    """``key, k, v``: densities by the median over half-overlapping segments."""
    norm = RATE * SEGMENT * 3 / 8
    return [
        f"seg AS (SELECT {key}, s, a[s * {SEGMENT // 2} + 1 : s * {SEGMENT // 2} + {SEGMENT}] AS x FROM {source}, range({2 * N // SEGMENT - 1}) r(s))",
        f"seg2 AS (SELECT {key}, s, list_transform(range({SEGMENT}), lambda i: (x[i + 1] - list_avg(x)) * {_WINDOW}) AS x FROM seg)",
        _sums("spec", "seg2", "x", SEGMENT, f"{key}, s"),
        f"pow_ AS (SELECT {key}, unnest(range({SEGMENT // 2 + 1})) AS k, unnest(list_transform(range({SEGMENT // 2 + 1}), lambda k: (re[k + 1] * re[k + 1] + im[k + 1] * im[k + 1]) * (CASE WHEN k IN (0, {SEGMENT // 2}) THEN 1 ELSE 2 END) / {norm})) AS p FROM spec)",
        f"wl AS (SELECT {key}, k, quantile_cont(p, 0.5) / {_BIAS!r} AS v FROM pow_ GROUP BY ALL)",
    ]


def _recolour_sql() -> str:
    ratio = N // SEGMENT
    first = int(LOW)
    fine = f"list_transform(range({N // 2 + 1}), lambda j: CASE WHEN j = {N // 2} THEN p[{SEGMENT // 2 + 1}] ELSE p[j // {ratio} + 1] + (p[j // {ratio} + 2] - p[j // {ratio} + 1]) * (j % {ratio}) / {ratio} END)"
    inverse = f"list_transform(range({N // 2 + 1}), lambda j: CASE WHEN j >= {first} AND j < {N // 2} THEN 1 / sqrt(f[j + 1]) ELSE 0 END)"
    zeros = f"list_transform(range({N // 2 + 1}), lambda j: 0.0::DOUBLE)"
    near = f"least(i, {N} - i)"
    window = f"list_transform(range({N}), lambda i: CASE WHEN {near} < {TAPS // 2} OR i = {N - TAPS // 2} THEN q[i + 1] * (0.5 + 0.5 * cos({_PI2} * {near} / {TAPS})) ELSE 0 END)"
    gain = f"list_transform(range({N // 2 + 1}), lambda k: sqrt({_list(_level(OTHER))}[k + 1]) * sqrt(own[k + 1]))"
    return _with(
        "SELECT vec_id, unnest(range(len(b)))::INT AS pos, round(unnest(b), 6) + 0.0 AS v FROM ("
        f"SELECT e.vec_id, CASE WHEN {counters.draw_sql('e.vec_id', SEED)} < {round(RECOLOURED * counters.RANGE)} THEN c.b ELSE e.a[{TAPS // 2 + 1} : {N - TAPS // 2}] END AS b FROM e JOIN c USING (vec_id))",
        *_welch("e", "vec_id"),
        "p1 AS (SELECT vec_id, list(v ORDER BY k) AS p FROM wl GROUP BY vec_id)",
        f"p2 AS (SELECT vec_id, {fine} AS f FROM p1)",
        f"p3 AS (SELECT vec_id, {inverse} AS g FROM p2)",
        f"p4 AS (SELECT vec_id, {_back('g', zeros, N)} AS q FROM p3)",
        f"p5 AS (SELECT vec_id, {window} AS q FROM p4)",
        _sums("p6", "p5", "q", N, "vec_id"),
        f"p7 AS (SELECT vec_id, list_transform(range({N // 2 + 1}), lambda k: re[k + 1] * re[k + 1] + im[k + 1] * im[k + 1]) AS own FROM p6)",
        _sums("x", "e", "a", N, "vec_id"),
        f"g AS (SELECT x.vec_id, re, im, {gain} AS g FROM x JOIN p7 USING (vec_id))",
        f"h AS (SELECT vec_id, list_transform(range({N // 2 + 1}), lambda k: re[k + 1] * g[k + 1]) AS re, list_transform(range({N // 2 + 1}), lambda k: im[k + 1] * g[k + 1]) AS im FROM g)",
        f"c AS (SELECT vec_id, ({_back('re', 'im', N)})[{TAPS // 2 + 1} : {N - TAPS // 2}] AS b FROM h)",
    )


def _colour_sql() -> str:
    draw = lambda det, i: " + ".join(f"{float(t) * SCALE!r}::DOUBLE * w[{8 - j} + 1]" for j, t in enumerate(COLOUR[det]))
    parts = []
    for i, det in enumerate(COLOUR):
        place = f"(SELECT det, seg, pos, unnest(range(9)) AS j, seg * {noise.REACH} + start + pos - 4 + unnest(range(9)) AS place FROM (SELECT det, seg, start, unnest(range(n)) AS pos FROM ext WHERE det = '{det}'))"
        white = f"(SELECT det, seg, pos, list(w ORDER BY j) AS w FROM (SELECT *, {counters.normal_sql('place', SEED, i)} AS w FROM {place}) GROUP BY ALL)"
        parts.append(f"SELECT det, seg, pos, round({draw(det, i)}, 6) AS v FROM {white}")
    return f"WITH {R.SQL}, {R.STRAIN} " + " UNION ALL ".join(parts)


ORACLES = {
    "whiten": _with(
        _unnested(f"({_back('re', 'im', N)})[{TAPS // 2 + 1} : {N - TAPS // 2}]", "y"),
        _sums("x", "e", "a", N, "vec_id"),
        f"y AS (SELECT vec_id, list_transform(range({N // 2 + 1}), lambda k: re[k + 1] / sqrt({_list(_level(PSD))}[k + 1])) AS re, list_transform(range({N // 2 + 1}), lambda k: im[k + 1] / sqrt({_list(_level(PSD))}[k + 1])) AS im FROM x)",
    ),
    "welch": _with("SELECT vec_id, k::INT AS pos, round(v, 6) AS v FROM wl", *_welch("e", "vec_id")),
    "recolour": _recolour_sql(),
    "phase_rotate": _with(
        _unnested(_back("re", "im", N), "y"), _sums("x", "e", "a", N, "vec_id"),
        f"y AS (SELECT vec_id, list_transform(range({N // 2 + 1}), lambda k: re[k + 1] * {float(np.cos(ANGLE))!r} - im[k + 1] * {float(np.sin(ANGLE))!r}) AS re, list_transform(range({N // 2 + 1}), lambda k: re[k + 1] * {float(np.sin(ANGLE))!r} + im[k + 1] * {float(np.cos(ANGLE))!r}) AS im FROM x)",
    ),
    "resample": _with(
        _unnested(f"list_transform({_back('re', 'im', 48)}, lambda v: v * 48.0 / {N})", "y"), _sums("x", "e", "a", N, "vec_id"),
        "y AS (SELECT vec_id, re[1:24] || [2 * re[25]] AS re, im[1:25] AS im FROM x)",
    ),
    "optimal_snr": _with(
        f"SELECT vec_id, 0 AS pos, round(4 * list_sum(list_transform(range({int(LOW)}, {N // 2}), lambda k: (re[k + 1] * re[k + 1] + im[k + 1] * im[k + 1]) / {RATE**2} / {_list(K.interpolated(np.array(PSD), 2.0, 1.0)[0])}[k + 1])), 6) AS v FROM x",
        _sums("x", "e", "a", N, "vec_id"),
    ),
    "band_pass": _filtered(BAND, "b"),
    "high_pass": _filtered(HIGH, "h"),
    "monorate": _with(_unnested("a", _every(4)[1]), *_every(4)[0]),
    "multirate": _with(_unnested(f"(s.a[1:16] || e.a[33:64])[{TRIM[0] + 1} : {48 - TRIM[1]}]", "e JOIN slow2 s USING (vec_id)"), *_every(2)[0]),
    "white_noise": f"SELECT event_id, round({counters.normal_sql('event_id', SEED, 0)}, 6) AS h1, round({counters.normal_sql('event_id', SEED, 1)}, 6) AS l1 FROM events WHERE event_id IS NOT NULL",
    "coloured_noise": _colour_sql(),
    "psd_bank": f"WITH {R.SQL}, {R.STRAIN}, bl AS (SELECT det, seg, pos // {R.BLOCK} AS block, list(v ORDER BY pos) AS a FROM smp GROUP BY ALL HAVING count(*) = {R.BLOCK}), "
    + ", ".join(_welch("bl", "det, seg, block"))
    + ", ch AS (SELECT det, seg, block // 4 AS chunk, k, avg(v) AS v FROM wl GROUP BY ALL HAVING count(*) = 4) SELECT det, seg, chunk, k::INT AS k, round(v, 4) AS v FROM ch",
}
