"""Spectral power and baselines: Morlet power, FFT resampling, filters, z-scores, band means, centring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators.shaping import windowed_moments
from sigloom.session import broadcast_if_small


def log_power(df: DataFrame, value: str) -> DataFrame:
    """Natural logarithm of power (SP2); null where power is not positive."""
    return df.withColumn(value, F.when(F.col(value) > 0, F.ln(value)))


def zscore_baseline(df: DataFrame, keys: list[str], value: str, in_baseline: Column) -> DataFrame:
    """(value - mean) / population std of the keys' baseline samples (SP3); null where the std is 0.

    Moments are aggregated with map-side combine and joined back; nothing is sorted, and no group has to fit a task.
    """
    m = windowed_moments(df, keys, value, in_baseline)
    return df.join(broadcast_if_small(m), keys).withColumn(value, F.when(F.col("b_std") > 0, (F.col(value) - F.col("b_mean")) / F.col("b_std"))).drop("b_mean", "b_std")


def subtract_baseline(df: DataFrame, keys: list[str], value: str, in_baseline: Column) -> DataFrame:
    """value less the mean of the keys' baseline samples (SP4, SP9 'mean', SP10)."""
    m = windowed_moments(df, keys, value, in_baseline)
    return df.join(broadcast_if_small(m), keys).withColumn(value, F.col(value) - F.col("b_mean")).drop("b_mean", "b_std")


def read_baseline(df: DataFrame, keys: list[str], value: str, in_baseline: Column, mode: str | None) -> DataFrame:
    """Baseline options on reading (SP9): 'mean', 'z_score' or None; anything else is an error."""
    if mode is None:
        return df
    if mode == "mean":
        return subtract_baseline(df, keys, value, in_baseline)
    if mode == "z_score":
        return zscore_baseline(df, keys, value, in_baseline)
    raise ValueError(f"baseline mode {mode!r}")


def band_means(df: DataFrame, members: DataFrame, freq: str, keys: list[str], value: str) -> DataFrame:
    """(keys..., band_idx, value): unweighted mean over each band's member frequencies; bands overlap (SP6)."""
    return df.join(broadcast_if_small(members.select(F.col("freq").alias(freq), "band_idx")), freq).groupBy(*keys, "band_idx").agg(F.avg(value).alias(value))


def dense_conditions(df: DataFrame, codes: DataFrame, code: str, keys: list[str], value: str) -> DataFrame:
    """Means by code with a zero where a code is absent (SP8): codes x the keys that occur."""
    got = df.groupBy(code, *keys).agg(F.avg(value).alias("_v"))
    grid = df.select(*keys).distinct().crossJoin(broadcast_if_small(codes.select(code)))
    return grid.join(got, [code, *keys], "left").withColumn(value, F.coalesce("_v", F.lit(0.0))).drop("_v")


def centre(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value less its mean over all rows with the same keys (SP12: keys are the time points, the mean is over channels)."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(broadcast_if_small(m), keys).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def as_series(df: DataFrame, keys: list[str], idx: str, value: str, out: str = "series") -> DataFrame:
    """Long rows as one ordered array a group."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias(out))


def from_series(df: DataFrame, keys: list[str], idx: str, value: str, series: str = "series") -> DataFrame:
    """Arrays back to long rows."""
    return df.select(*keys, F.posexplode(series).alias(idx, value))


def morlet_power(x: np.ndarray, fs: float, freqs: list[float], n_cycles: list[float]) -> np.ndarray:
    """Power (freq x time) of a series by complex Morlet wavelets of unit energy, by FFT convolution, same length (SP1)."""
    n = len(x)
    out = np.empty((len(freqs), n))
    for k, (f, c) in enumerate(zip(freqs, n_cycles)):
        s = c / (2 * np.pi * f)
        half = int(np.ceil(5 * s * fs))
        t = np.arange(-half, half + 1) / fs
        w = np.exp(2j * np.pi * f * t) * np.exp(-(t**2) / (2 * s**2))
        w /= np.sqrt(0.5) * np.linalg.norm(w)
        m = n + len(w) - 1
        y = np.fft.ifft(np.fft.fft(x, m) * np.fft.fft(w, m))[half : half + n]
        out[k] = np.abs(y) ** 2
    return out


def _series_kernel(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """One series a row through a numpy kernel; rows stay independent, so any partitioning will do."""

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                for extra in fn(np.asarray(r.series, dtype=float)):
                    rows.append((*r[: len(keys)], *extra))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(",")])

    return df.select(*keys, "series").mapInPandas(run, schema)


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def tfr(series: DataFrame, keys: list[str], fs: float, freqs: list[float], n_cycles: list[float]) -> DataFrame:
    """(keys..., freq_idx, power array) of every series (SP1)."""
    return _series_kernel(series, keys, lambda x: [(i, p.tolist()) for i, p in enumerate(morlet_power(x, fs, freqs, n_cycles))], f"{_key_schema(series, keys)}, freq_idx int, power array<double>")


def resample(x: np.ndarray, m: int) -> np.ndarray:
    """Fourier resampling to m points (TS2)."""
    n = len(x)
    f = np.fft.rfft(x)
    keep = min(n, m) // 2 + 1
    g = np.zeros(m // 2 + 1, dtype=complex)
    g[:keep] = f[:keep]
    if m != n and min(n, m) % 2 == 0:
        g[min(n, m) // 2] *= 1.0 if m < n else 0.5
    return np.fft.irfft(g, m) * m / n


def resampled(series: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """(keys..., series) with ratio times as many points (TS2)."""
    return _series_kernel(series, keys, lambda x: [(resample(x, max(1, round(len(x) * ratio))).tolist(),)], f"{_key_schema(series, keys)}, series array<double>")


def _low_pass(cut: float, fs: float, n: int) -> np.ndarray:
    """Hamming-windowed sinc of n (odd) taps, of unit gain at 0."""
    k = np.arange(n) - n // 2
    h = 2 * cut / fs * np.sinc(2 * cut / fs * k) * np.hamming(n)
    return h / h.sum()


def fir_taps(fs: float, high_pass: float | None = None, notches: list[float] = ()) -> list[np.ndarray]:
    """Linear-phase FIR filters, one for the high-pass and one a notch, to be applied in turn (TS3).

    A filter has 3.3 / transition seconds of taps. The high-pass has a transition as wide as its edge (at most 2 Hz,
    centred half of it below); a notch is its frequency / 200 wide, with transitions of 1 Hz.
    """
    odd = lambda width: int(np.ceil(3.3 / width * fs)) // 2 * 2 + 1
    out = []
    if high_pass:
        width = min(max(0.25 * high_pass, 2.0), high_pass)
        n = odd(width)
        h = -_low_pass(high_pass - width / 2, fs, n)
        h[n // 2] += 1
        out.append(h)
    for f in notches:
        n = odd(1.0)
        half = f / 400 + 0.5
        h = -_low_pass(min(f + half, fs / 2), fs, n) + _low_pass(f - half, fs, n)
        h[n // 2] += 1
        out.append(h)
    return out


def fir_apply(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Zero-phase filtering: the series is mirrored in its end points as often as the taps need, and convolved by FFT."""
    if len(x) < 2:
        return x.copy()
    half, period = len(taps) // 2, 2 * (len(x) - 1)
    # position i of the mirrored series: a walk to and fro, which falls by twice the end value at each turn past it
    i = np.arange(-half, len(x) + half)
    turn, at = np.divmod(i, period)
    back = at >= len(x)
    y = np.where(back, 2 * x[-1] - x[np.where(back, period - at, at)], x[np.where(back, period - at, at)]) + turn * 2 * (x[-1] - x[0])
    m = len(y) + len(taps) - 1
    return np.fft.irfft(np.fft.rfft(y, m) * np.fft.rfft(taps, m), m)[2 * half : 2 * half + len(x)]


def fir_filter(x: np.ndarray, fs: float, high_pass: float | None = None, notches: list[float] = ()) -> np.ndarray:
    """A series through fir_taps() in turn (TS3)."""
    for taps in fir_taps(fs, high_pass, notches):
        x = fir_apply(x, taps)
    return x


def filtered(series: DataFrame, keys: list[str], fs: float, high_pass: float | None = None, notches: list[float] = ()) -> DataFrame:
    """(keys..., series) after fir_filter(); the taps are made once."""
    all_taps = fir_taps(fs, high_pass, notches)

    def run(x: np.ndarray) -> list[tuple]:
        for taps in all_taps:
            x = fir_apply(x, taps)
        return [(x.tolist(),)]

    return _series_kernel(series, keys, run, f"{_key_schema(series, keys)}, series array<double>")
