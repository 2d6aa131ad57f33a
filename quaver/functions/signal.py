"""Spectral kernels over batches of series, a row each, and how they become column functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Values of arrays that a kernel takes at once.
BATCH_VALUES = 1 << 21


def welch(x: np.ndarray, rate: float, size: int) -> np.ndarray:
    """One-sided density by the median of half-overlapping Hann segments without their means, freed of the median's bias."""
    size = min(size, x.shape[1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = size - size // 2
    parts = np.stack([x[:, s : s + size] for s in range(0, x.shape[1] - size + 1, step)], axis=1)
    parts = parts - parts.mean(axis=2, keepdims=True)
    power = np.abs(np.fft.rfft(parts * window, axis=2)) ** 2 / (rate * (window**2).sum())
    power[:, :, 1 : None if size % 2 else -1] *= 2
    twice = 2 * np.arange(1, (parts.shape[1] - 1) // 2 + 1)
    return np.median(power, axis=1) / (1 + (1 / (twice + 1) - 1 / twice).sum())


def interpolated(psd: np.ndarray, step: float, new_step: float) -> np.ndarray:
    """A density, a row each, at bins of another width."""
    n = int(np.rint((psd.shape[-1] - 1) * step / new_step)) + 1
    at, known = np.arange(n) * new_step, np.arange(psd.shape[-1]) * step
    return np.stack([np.interp(at, known, p) for p in np.atleast_2d(psd)])


def truncated(psd: np.ndarray, step: float, taps: int, low: float) -> np.ndarray:
    """A density whose inverse filter in time has ``taps`` samples, under a Hann window; nothing passes below ``low``."""
    n = 2 * (psd.shape[1] - 1)
    if taps > n:
        raise ValueError("the filter is longer than the series")
    inverse, first = np.zeros_like(psd), int(low / step) if low else 1
    inverse[:, first : n // 2] = psd[:, first : n // 2] ** -0.5
    q = np.fft.irfft(inverse, n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(taps) / taps)
    half = taps // 2
    q[:, :half] *= window[half : 2 * half]
    q[:, n - half :] *= window[:half]
    q[:, half : n - half] = 0
    return 1 / np.abs(np.fft.rfft(q)) ** 2


def whiten(x: np.ndarray, psd: np.ndarray, step: float, rate: float, taps: int, low: float, trim: bool = True) -> np.ndarray:
    """Rows over the root of a density at bins of ``step``, one or one a row, interpolated and truncated; half a filter's length goes at both ends."""
    n = x.shape[1]
    level = truncated(interpolated(np.asarray(psd, float), step, rate / n), rate / n, taps, low)
    white = np.fft.irfft(np.fft.rfft(x) / np.sqrt(level), n)
    return white[:, taps // 2 : n - taps // 2] if trim else white


def recolour(x: np.ndarray, other: np.ndarray, other_step: float, rate: float, size: int, taps: int, low: float) -> np.ndarray:
    """Rows whitened by their own Welch density and coloured by another one."""
    n = x.shape[1]
    own = truncated(interpolated(welch(x, rate, size), rate / size, rate / n), rate / n, taps, low)
    new = truncated(interpolated(np.asarray(other, float), other_step, rate / n), rate / n, taps, low)
    out = np.fft.irfft(np.fft.rfft(x) * np.sqrt(new / own), n)
    return out[:, taps // 2 : n - taps // 2]


def amplitude(psd: np.ndarray, step: float, rate: float, seconds: float, around: float, low: float) -> np.ndarray:
    """The amplitude of a filter that colours ``seconds`` of noise with ``around`` seconds before and after; nothing below ``low``.

    Bins beyond the density's last but one repeat that, zeros are its greatest value. The filter is ``around`` seconds long to
    either side if the density's bins allow it.
    """
    psd, n = np.asarray(psd, float), int(rate / step) // 2 + 1
    out = np.r_[psd, np.zeros(max(0, n - len(psd)))][:n]
    out[len(psd) - 1 :] = psd[-2]
    out[out == 0] = out.max()
    taps, whole = int(around * rate), int((seconds + 2 * around) * rate)
    if step >= 1 / (2 * around):
        step = 1 / (2 * around)
        fine = interpolated(out, rate / (2 * (n - 1)), step)
        q = np.fft.irfft(1 / truncated(1 / fine, step, taps, low), 2 * (fine.shape[1] - 1))[0]
        # The filter's two halves stand at the ends of a longer series.
        q = np.r_[q[:taps], np.zeros(max(0, whole - 2 * taps)), q[len(q) - taps :]]
        out, step = np.abs(np.fft.rfft(q)), rate / len(q)
    out[: int(low / step)] = 0
    return np.sqrt(out)


def rotate_phase(x: np.ndarray, angle: float) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(x) * np.exp(1j * angle), x.shape[1])


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """To n samples by cutting or padding the spectrum; what stands at half the lower rate counts for both signs."""
    spectrum, least = np.fft.rfft(x), min(n, x.shape[1])
    out = np.zeros((len(x), n // 2 + 1), complex)
    out[:, : least // 2 + 1] = spectrum[:, : least // 2 + 1]
    if least % 2 == 0 and n != x.shape[1]:
        out[:, least // 2] *= 2 if n < x.shape[1] else 0.5
    return np.fft.irfft(out, n) * (n / x.shape[1])


def sigma2(x: np.ndarray, psd: np.ndarray, step: float, rate: float, low: float = 0.0) -> np.ndarray:
    """Optimal SNR squared of each row against a density at bins of ``step``, from ``low`` on."""
    n = x.shape[1]
    level = interpolated(np.asarray(psd, float), step, rate / n)
    strength = np.abs(np.fft.rfft(x) / rate) ** 2 / level[:, : n // 2 + 1]
    return 4 * (rate / n) * strength[:, int(low * n / rate) : n // 2].sum(axis=1)[:, None]


def by_length(series: pd.Series, kernel: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """A kernel over matrices of arrays of one length, some megabytes at a time; null arrays stay null."""
    out = pd.Series([None] * len(series), index=series.index, dtype=object)
    sizes = series.map(lambda a: -1 if a is None else len(a))
    for size, own in sizes.groupby(sizes):
        step = max(1, BATCH_VALUES // max(1, size))
        for at in range(0, len(own) if size > 0 else 0, step):
            rows = own.index[at : at + step]
            out[rows] = list(kernel(np.stack([np.asarray(a, float) for a in series[rows]])))
        if size == 0:
            out[own.index] = [[] for _ in own.index]
    return out


def column_of(kernel: Callable[..., np.ndarray], *args):
    """A kernel with fixed arguments as a column function over an array column; an empty array gives an empty one."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return by_length(series, lambda x: kernel(x, *args))

    return run
