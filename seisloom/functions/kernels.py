"""Per-batch numpy kernels for what column expressions cannot say: spectra, hashes with wrap-around, seeded generators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

MASK = (1 << 64) - 1
_HANN = 0.5 * (1 - np.cos(2 * np.pi * np.arange(256) / 255))


def log_spectrum(frames: np.ndarray) -> np.ndarray:
    """log10(1 + |bin|) of bins 0 .. 127 of Hann-windowed frames of 256."""
    return np.log10(1 + np.abs(np.fft.rfft(frames * _HANN, axis=1)[:, :128]))


def z_scores(rows: np.ndarray) -> np.ndarray:
    """Against each row's mean and population deviation, of at least 1e-8."""
    return (rows - rows.mean(1, keepdims=True)) / np.maximum(rows.std(1, keepdims=True), 1e-8)


def window_hashes(frames: np.ndarray) -> np.ndarray:
    """Multiply-xor hashes over whole sign-extended samples, modulo 2^64."""
    h = np.full(len(frames), 0xCBF29CE484222325, np.uint64)  # fixed values: the 64-bit offset and prime of this hash family
    with np.errstate(over="ignore"):
        for column in frames.T.astype(np.int64).view(np.uint64) if len(frames) else ():
            h = (h ^ column) * np.uint64(0x100000001B3)
    return h


@F.pandas_udf(StringType())
def window_hash(samples: pd.Series) -> pd.Series:
    return pd.Series([str(x) for x in window_hashes(np.stack(samples))]) if len(samples) else pd.Series([], dtype=str)


def lcg_noise(seed: int, n: int, level: float) -> np.ndarray:
    """A linear congruential generator's top 31 bits over 2^32 - 1, so that values lie in [-level, 0)."""
    out, state = np.empty(n), seed & MASK
    for k in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) & MASK  # fixed values: the generator's multiplier and increment
        out[k] = ((state >> 33) / 0xFFFFFFFF - 0.5) * 2 * level
    return out


class XorShift:
    """A 64-bit shift-register generator (13, 7, 17)."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def bits(self) -> int:
        x = self.state
        x ^= (x << 13) & MASK
        x ^= x >> 7
        x ^= (x << 17) & MASK
        self.state = x
        return x


def _centred_means(rows: np.ndarray, centres: np.ndarray, before: int, after: int) -> np.ndarray:
    """Means of each row over [centre - before, centre + after], clipped to the row."""
    total = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(rows, axis=1)], axis=1)
    low, high = np.maximum(centres - before, 0), np.minimum(centres + after, rows.shape[1] - 1) + 1
    return (total[:, high] - total[:, low]) / (high - low)


def _over_max(rows: np.ndarray) -> np.ndarray:
    top = rows.max(1, keepdims=True)
    return np.where(top > 1e-8, rows / np.where(top > 1e-8, top, 1), rows)


def envelopes(frames: np.ndarray, points: int, radius: int, halvings: int) -> np.ndarray:
    """Means of the rectified signal, halved by pair means, around `points` centres, over their largest."""
    rows = np.abs(frames)
    for _ in range(halvings):
        rows = (rows[:, 0::2] + rows[:, 1::2]) / 2
    step = rows.shape[1] / points
    return _over_max(_centred_means(rows, np.floor(np.arange(points) * step + step / 2).astype(int), radius, radius))


def onset_ratios(frames: np.ndarray, points: int = 16, short: int = 5, long: int = 50) -> np.ndarray:
    """Short-term over long-term mean amplitude at 16 j + 8, over their largest."""
    rows, centres = np.abs(frames), 16 * np.arange(points) + 8
    lta = _centred_means(rows, centres, long, long - 1)
    return _over_max(np.where(lta > 1e-8, _centred_means(rows, centres, short, short - 1) / np.where(lta > 1e-8, lta, 1), 0))


def autocorrelations(frames: np.ndarray, lags: int = 32) -> np.ndarray:
    """Biased autocorrelation at lags 1 .. lags over n times the variance; zeros if that is next to nothing."""
    centred = frames - frames.mean(1, keepdims=True)
    power = (centred * centred).sum(1)
    sums = np.stack([(centred[:, :-lag] * centred[:, lag:]).sum(1) for lag in range(1, lags + 1)], 1)
    flat = (power / frames.shape[1] < 1e-10)[:, None]
    return np.where(flat, 0, sums / np.where(flat, 1, power[:, None]))


def of_frames(kernel):
    """A column function of arrays of samples from a function of a matrix with a row for each frame."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series(list(kernel(np.stack(samples).astype(float)))) if len(samples) else pd.Series([], dtype=object)

    return run


spectrum = of_frames(log_spectrum)
spectrum_z = of_frames(lambda frames: z_scores(log_spectrum(frames)))
envelope_fine = of_frames(lambda frames: envelopes(frames, 16, 8, 0))
envelope_medium = of_frames(lambda frames: envelopes(frames, 8, 4, 1))
envelope_coarse = of_frames(lambda frames: envelopes(frames, 8, 4, 2))
sta_lta = of_frames(onset_ratios)
autocorrelation = of_frames(autocorrelations)
