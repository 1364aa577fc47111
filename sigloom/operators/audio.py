"""Audio onset alignment: smoothing, peaks and delays against a reference recording."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small


def savgol_weights(width: int = 15, order: int = 3) -> list[float]:
    """Convolution weights of a Savitzky-Golay smoother."""
    h = width // 2
    v = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    return np.linalg.pinv(v)[0].tolist()


def savgol(df: DataFrame, keys: list[str], idx: str, value: str, width: int = 15, order: int = 3) -> DataFrame:
    """Smoothed value (TS11); positions within half a window of an end are null."""
    w = Window.partitionBy(*keys).orderBy(idx)
    h = width // 2
    total = sum(F.lit(c) * (F.lag(value, -k).over(w) if k <= 0 else F.lead(value, k).over(w)) for k, c in zip(range(-h, h + 1), savgol_weights(width, order)))
    return df.withColumn(value, total)


def first_peak(df: DataFrame, keys: list[str], idx: str, value: str, height: float) -> DataFrame:
    """(keys..., peak): index of the first local maximum of at least `height`, null if there is none."""
    w = Window.partitionBy(*keys).orderBy(idx)
    x = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    at = F.when((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= height), F.col(idx))
    return x.groupBy(*keys).agg(F.min(at).alias("peak"))


def peak_delay(df: DataFrame, key: str, idx: str, value: str, reference: str, head: int = 160, tolerance: float = 100.0, least: int = 10) -> DataFrame:
    """(key, peak, delay): the reference's peak within its head less each file's first peak of about its height; below `least` it is 0 (TS11)."""
    ref = df.where((F.col(key) == reference) & (F.col(idx) < head)).agg(F.max_by(idx, value).alias("ref_peak"), F.max(value).alias("ref_value"))
    w = Window.partitionBy(key).orderBy(idx)
    x = df.crossJoin(F.broadcast(ref)).withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))  # one row
    at = F.when((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= F.col("ref_value") - tolerance), F.col(idx))
    g = x.groupBy(key, "ref_peak").agg(F.min(at).alias("peak"))
    d = F.col("ref_peak") - F.col("peak")
    return g.select(key, "peak", F.when(F.abs(d) < least, 0).otherwise(d).alias("delay"))


def align(df: DataFrame, delays: DataFrame, key: str, idx: str) -> DataFrame:
    """Index moved by the absolute delay (TS12)."""
    return df.join(broadcast_if_small(delays.select(key, "delay")), key).withColumn(idx, F.col(idx) - F.abs("delay")).where(F.col(idx) >= 0).drop("delay")
