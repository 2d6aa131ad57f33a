import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from quaver.functions import filters, multirate, signal
from quaver.operators import counters, noise


def response(sections, frequency, rate):
    z = np.exp(-2j * np.pi * np.asarray(frequency) / rate)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sections], axis=0)


@pytest.mark.parametrize("order", [1, 2, 3, 5, 8])
def test_designs_have_their_closed_form(order):
    f, rate = np.linspace(1, 1000, 77), 2048.0
    w = np.tan(np.pi * f / rate)
    low, high = np.tan(np.pi * 100 / rate), np.tan(np.pi * 400 / rate)
    assert np.allclose(np.abs(response(filters.butterworth(order, rate, low=100), f, rate)) ** 2, 1 / (1 + (low / w) ** (2 * order)))
    assert np.allclose(np.abs(response(filters.butterworth(order, rate, high=400), f, rate)) ** 2, 1 / (1 + (w / high) ** (2 * order)))
    band = (w * w - low * high) / (w * (high - low))
    assert np.allclose(np.abs(response(filters.butterworth(order, rate, 100, 400), f, rate)) ** 2, 1 / (1 + band ** (2 * order)))
    for q in (2, 5, 13):
        sections, edge = filters.chebyshev(order, 0.05, 0.8 / q), np.tan(np.pi * 0.4 / q)
        x = np.tan(np.pi * f / rate) / edge
        poly = np.where(x <= 1, np.cos(order * np.arccos(np.minimum(x, 1))), np.cosh(order * np.arccosh(np.maximum(x, 1))))
        assert np.allclose(np.abs(response(sections, f, rate)) ** 2, 1 / (1 + (10**0.005 - 1) * poly**2))
    poles = [np.roots([1, a1, a2]) for *_, a1, a2 in filters.butterworth(order, rate, 16, 512)]
    assert max(abs(p) for ps in poles for p in ps) < 1


def recurrence(b, a, x, before):
    """One difference equation, its past a constant input."""
    level = before * sum(b) / sum(a)
    xs, ys = [before] * len(b) + list(x), [level] * len(a)
    for n in range(len(x)):
        i = n + len(b)
        ys.append(sum(c * xs[i - k] for k, c in enumerate(b)) - sum(c * ys[-k] for k, c in enumerate(a) if k))
    return ys[len(a) :]


def test_zero_phase_equals_a_direct_recurrence():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3, 90))
    for sections in (filters.butterworth(2, 64, 4, 24), filters.butterworth(3, 64, low=5), filters.chebyshev(4, 0.05, 0.3)):
        b, a = np.array([1.0]), np.array([1.0])
        for s in sections:
            b, a = np.polymul(b, s[:3]), np.polymul(a, s[3:])
        pad = filters.padding(sections, 90)
        for row, got in zip(x, filters.zero_phase(x, sections)):
            y = np.r_[2 * row[0] - row[pad:0:-1], row, 2 * row[-1] - row[-2 : -pad - 2 : -1]]
            for _ in range(2):
                y = np.array(recurrence(b, a, y, y[0]))[::-1]
            assert np.allclose(got, y[pad:-pad], atol=1e-8)
    impulse = np.zeros((1, 40))
    impulse[0, 0] = 1
    b0, b1, b2, _, a1, a2 = filters.butterworth(2, 64, low=5)[0]
    want = [b0, b1 - a1 * b0]
    want.append(b2 - a1 * want[1] - a2 * want[0])
    for _ in range(37):
        want.append(-a1 * want[-1] - a2 * want[-2])
    assert np.allclose(filters.run(filters.butterworth(2, 64, low=5), impulse)[0], want)
    assert filters.zero_phase(x[:, :5], sections).shape == (3, 5) and filters.zero_phase(x[:, :1], sections).shape == (3, 1)


def test_decimation_in_stages():
    assert filters.prime_factors(360) == [2, 2, 2, 3, 3, 5] and filters.stages(13) == [13] and filters.stages(32) == [2] * 5
    with pytest.raises(ValueError):
        filters.stages(34)
    t = np.arange(4096) / 2048
    slow = np.sin(2 * np.pi * 5 * t)[None, :]
    # An even order passes a constant at the depth of its ripples, twice in each of four stages.
    depth = 10 ** (-0.05 / 20 * 8)
    assert np.allclose(filters.decimate(slow + np.sin(2 * np.pi * 300 * t), 16)[0, 8:-8], depth * slow[0, ::16][8:-8], atol=0.01)
    staged = slow
    for _ in range(4):
        staged = filters.decimate(staged, 2)
    assert np.allclose(filters.decimate(slow, 16), staged)


def walked(plan):
    """A walk over the times, one by one."""
    t, f, last = multirate.frequencies(plan)
    edges, top, quiet, loud = [0], last, True, True
    for n, x in enumerate(f):
        if top < plan.low_frequency:
            break
        if x == multirate.MERGER and quiet:
            edges.append(n)
            quiet = False
        elif last / 2 < x < multirate.MERGER and loud:
            edges.append(n)
            loud = False
        elif x < top / plan.band_factor and x != multirate.NOISE:
            edges.append(n)
            top /= plan.band_factor
    return [*edges, len(f)]


def test_bins_and_lengths():
    for plan in (multirate.Plan(), multirate.Plan(seconds=12, merger_from=11.0, merger_to=11.2), multirate.Plan(low_frequency=15, band_factor=1.5), multirate.Plan(low_mass=3.0)):
        parts, edges = multirate.bins(plan), walked(plan)
        assert sorted({plan.samples - e for e in edges}) == sorted({p[0] for p in parts} | {p[1] for p in parts})
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and (parts[0][0], parts[-1][1]) == (0, plan.samples)
        rates = [p[2] for p in parts]
        assert rates[-1] == 64 and rates[-2] == plan.rate and all(np.isclose(b, a * plan.rate_factor) for a, b in zip(rates[:-2], rates[1:-2]))
    with pytest.raises(ValueError):
        multirate.bins(multirate.Plan(start_factor=1.5))
    x = np.random.default_rng(1).normal(0, 1, (2, 640))
    parts = [(0, 200, 16.0), (200, 500, 128.0), (500, 640, 512.0)]
    got = multirate.sample(x, parts, 512.0, (3, 4))
    assert got.shape == (2, multirate.sampled_length(parts, 640, 512.0, (3, 4)))
    want = np.hstack([filters.decimate(x, 32)[:, :6], filters.decimate(x, 4)[:, 50:125], x[:, 500:]])
    assert np.allclose(got, want[:, 3:-4])


def dft(x):
    n = len(x)
    return np.array([sum(x[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n)) for k in range(n)])


def test_whitening_is_a_short_filter_and_welch_a_median():
    rng = np.random.default_rng(2)
    x, psd = rng.normal(0, 1, (2, 64)), 1 + (np.arange(17) / 4.0) ** 2
    level = signal.truncated(signal.interpolated(psd, 2.0, 1.0), 1.0, 16, 3)
    kernel = np.real(np.fft.ifft(np.r_[level[0] ** -0.5, level[0][-2:0:-1] ** -0.5]))
    got = signal.whiten(x, psd, 2.0, 64.0, 16, 3, trim=False)
    assert np.allclose(got[1], [sum(kernel[j] * x[1, (i - j) % 64] for j in range(64)) for i in range(64)])
    # Not the kernel of the amplitude, but the truncated filter itself, is short.
    fine = np.interp(np.arange(33), np.arange(17) * 2, psd) ** -0.5
    fine[:3] = fine[32] = 0
    q = np.fft.irfft(fine, 64) * np.where(np.minimum(np.arange(64), 64 - np.arange(64)) <= 8, 0.5 + 0.5 * np.cos(np.pi * np.minimum(np.arange(64), 64 - np.arange(64)) / 8), 0)
    assert np.allclose(level[0], 1 / np.abs(dft(q)[:33]) ** 2)
    assert signal.whiten(x, psd, 2.0, 64.0, 16, 3).shape == (2, 48)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    parts = [np.abs(dft((x[0, s : s + 16] - x[0, s : s + 16].mean()) * window)[:9]) ** 2 / (64 * (window**2).sum()) for s in range(0, 49, 8)]
    want = np.median(parts, axis=0) * np.r_[1, np.full(7, 2), 1] / (1 - 1 / 2 + 1 / 3 - 1 / 4 + 1 / 5 - 1 / 6 + 1 / 7)
    assert np.allclose(signal.welch(x, 64.0, 16)[0], want)
    same = signal.recolour(x, signal.welch(x, 64.0, 16), 4.0, 64.0, 16, 16, 3)
    assert np.allclose(same, x[:, 8:-8])
    t = np.arange(64) / 64
    tone = np.sin(2 * np.pi * 5 * t)[None, :]
    assert np.allclose(signal.rotate_phase(tone, np.pi / 2)[0], np.cos(2 * np.pi * 5 * t)) and np.allclose(signal.resample(tone, 32), tone[:, ::2])
    assert np.allclose(signal.resample(signal.resample(x, 128), 64), x)
    assert np.allclose(signal.sigma2(tone, np.ones(33), 1.0, 64.0), 4 * (32 / 64) ** 2)
    with pytest.raises(ValueError):
        signal.truncated(np.ones((1, 5)), 1.0, 9, 0)


def test_amplitudes_pass_their_density():
    psd = 2.0 + np.sin(np.arange(129) / 20)
    psd[3] = 0
    flat = signal.amplitude(np.full(129, 4.0), 1.0, 256.0, 2, 1, 0)
    assert len(flat) == 256 * 4 // 2 + 1 and np.allclose(flat[8:-8], 2.0, rtol=0.01)
    shaped = signal.amplitude(psd, 0.25, 64.0, 2, 1, 5)
    assert (shaped[: int(5 / 0.25)] == 0).all() and np.allclose(shaped[20:100] ** 2, psd[20:100])


def test_arrays_of_any_length_in_one_batch():
    out = signal.by_length(pd.Series([[1.0, 2.0], None, [], [3.0, 4.0, 5.0], [5.0, 6.0]]), lambda x: x[:, ::-1])
    assert [None if v is None else list(v) for v in out] == [[2.0, 1.0], None, [], [5.0, 4.0, 3.0], [6.0, 5.0]]


def test_any_slice_of_noise_equals_the_whole(spark):
    taps = {"H1": noise.taps_of(1 / (1 + np.linspace(0, 3, 33) ** 2), 15), "L1": np.ones(1)}
    whole = spark.createDataFrame([("H1", 5, -20, 400), ("L1", 5, 0, 333), ("V1", 5, 0, 9), ("H1", 6, 0, 50), ("H1", 7, 0, 0)], "det string, seg long, start long, n long")

    def series(extents, size):
        rows = noise.noise(extents, size, 3, taps, 2.0).collect()
        keys = {(r["det"], r["seg"]) for r in rows}
        return {k: np.concatenate([r["samples"] for r in sorted(rows, key=lambda r: r["block"]) if (r["det"], r["seg"]) == k]) for k in keys}

    one, two = series(whole, 64), series(whole.repartition(3), 17)
    assert one.keys() == {("H1", 5), ("L1", 5), ("H1", 6)} and all(np.allclose(one[k], two[k]) for k in one)
    part = series(spark.createDataFrame([("H1", 5, 77, 100), ("L1", 5, 100, 40)], whole.schema), 8)
    assert np.allclose(part["H1", 5], one["H1", 5][97:197]) and np.allclose(part["L1", 5], one["L1", 5][100:140])
    white = counters.normals(5 * noise.REACH + np.arange(-60, 420), 3, 0)
    assert np.allclose(np.convolve(white, taps["H1"], "same")[40:440] * 2, one["H1", 5])
    native = spark.range(50).select(counters.normal(F.col("id") - 9, 4, 1).alias("v")).toPandas()["v"]
    assert np.allclose(native, counters.normals(np.arange(-9, 41), 4, 1))
