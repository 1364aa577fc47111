"""Time-series shaping: epochs, resampled and smoothed grids, normalisation, shifts, strides and baselines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small


def epochs(signal: DataFrame, events: DataFrame, entity: str, sample: str, value: str, event_keys: list[str], event_sample: str, before: int, after: int) -> DataFrame:
    """(event_keys..., entity, rel, value): the samples in [event-before, event+after] around every event (TS1).

    Both sides are binned by the window's length, so the range join is an equi-join on (entity, bin).
    """
    width = before + after + 1
    e = events.select(F.col(entity).alias("_e"), *event_keys, F.col(event_sample).alias("_at"))
    lo = F.floor((F.col("_at") - before) / width).cast("bigint")
    e = e.withColumn("_eb", F.explode(F.sequence(lo, F.floor((F.col("_at") + after) / width).cast("bigint"))))
    s = signal.withColumn("_sb", F.floor(F.col(sample) / width).cast("bigint"))
    hit = s.join(e, (F.col(entity) == F.col("_e")) & (F.col("_sb") == F.col("_eb")) & F.col(sample).between(F.col("_at") - before, F.col("_at") + after))
    return hit.select(entity, *[k for k in event_keys if k != entity], (F.col(sample) - F.col("_at")).alias("rel"), value)


def normalise(df: DataFrame, keys: list[str], value: str, divide: float = 1000.0) -> DataFrame:
    """(value - mean) / population std over the keys' rows, divided by `divide`; null where the std is 0 (TS4)."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s") / divide)
    return df.join(broadcast_if_small(g), keys).withColumn(value, z).drop("_m", "_s")


def hopping_grid(t_start: float, n: int, fs: float, step: float, width: float) -> list[tuple[int, float, int, int]]:
    """(index, centre, first sample, last sample) of every smoothing window over n samples from t_start.

    Centres run from half a window after the start, by `step`, to half a window before the end, one sample more allowed;
    window limits go to the nearest sample, the first on ties, and both belong to the window.
    """
    t = t_start + np.arange(n) / fs
    t_end = t_start + n / fs
    centres = np.arange(t_start + width / 2, t_end - width / 2 + 1 / fs, step)
    near = lambda x: int(np.argmin(np.abs(t - x)))
    return [(i, float(c), near(c - width / 2), near(c + width / 2)) for i, c in enumerate(centres)]


def smooth(df: DataFrame, keys: list[str], idx: str, value: str, grid: list[tuple[int, float, int, int]]) -> DataFrame:
    """(keys..., c_idx, centre, value): the mean of every window of hopping_grid() (TS5).

    Each sample looks up the windows that hold it in a small map and is exploded to them; one aggregation follows.
    """
    of: dict[int, list[tuple[int, float]]] = {}
    for i, c, lo, hi in grid:
        for s in range(lo, hi + 1):
            of.setdefault(s, []).append((i, c))
    spark = df.sparkSession
    dim = spark.createDataFrame([(s, i, c) for s, l in of.items() for i, c in l] or [(-1, -1, 0.0)], "_s int, c_idx int, centre double")
    x = df.join(broadcast_if_small(dim), F.col(idx) == F.col("_s"))
    return x.groupBy(*keys, "c_idx", "centre").agg(F.avg(value).alias(value))


def smooth_timestamps(df: DataFrame, keys: list[str], ts: str, value: str, width: str, step: str) -> DataFrame:
    """The timestamp variant: half-open windows aligned to the epoch."""
    return df.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), width, step).alias("w")).agg(F.avg(value).alias(value)).select(*keys, F.col("w.start").alias("w_start"), value)


def stride(df: DataFrame, idx: str, every: int = 5) -> DataFrame:
    """Every n-th time point (FLT9)."""
    return df.where(F.col(idx) % every == 0)


def crop(df: DataFrame, t: str, low: float, high: float, fs: float) -> DataFrame:
    """Rows within [low, high], half a sample of tolerance (FLT3)."""
    return df.where(F.col(t).between(low - 0.5 / fs, high + 0.5 / fs))


def shift(df: DataFrame, keys: list[str], idx: str, value: str, lag: int, wrap: bool = False) -> DataFrame:
    """The series moved by `lag` (TS9): positions without a source are null, or filled from the other end with wrap."""
    if not wrap:
        w = Window.partitionBy(*keys).orderBy(idx)
        return df.withColumn(value, F.lag(value, lag).over(w) if lag >= 0 else F.lead(value, -lag).over(w))
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(broadcast_if_small(n), keys).withColumn(idx, F.pmod(F.col(idx) + lag, F.col("_n")).cast(df.schema[idx].dataType)).drop("_n")


def split_halves(df: DataFrame, idx: str, half: int) -> DataFrame:
    """A concatenated time axis as (cond, t) keys (TS7, TS8): the first half is condition 1."""
    return df.withColumn("cond", F.when(F.col(idx) < half, 1).otherwise(2)).withColumn("t_half", (F.col(idx) % half).cast("int"))


def baseline_end(times: DataFrame, t: str, limit: float = -0.5) -> DataFrame:
    """One row: the index of the first sample at or after `limit`; the baseline is all before it (TS10, WN11)."""
    return times.where(F.col(t) >= limit).agg(F.min("t_idx").alias("b_end"))


def windowed_moments(df: DataFrame, keys: list[str], value: str, in_baseline: Column) -> DataFrame:
    """(keys..., b_mean, b_std): mean and population std over the baseline samples of each group."""
    v = F.when(in_baseline, F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("b_mean"), F.stddev_pop(v).alias("b_std"))


def line_harmonics(lowpass: float, line: float) -> list[float]:
    """Line frequency harmonics below the low-pass limit (TS3)."""
    return [k * line for k in range(1, math.ceil(lowpass / line))]
