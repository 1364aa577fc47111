"""Structured Streaming forms of response matching and windowed means; an extension to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, step: str, late: str) -> DataFrame:
    """Mean by key and hopping window with a watermark for late rows."""
    w = F.window(F.col(ts), width, step)
    return stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.avg(value).alias(value), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("w_start"), value, "n")


def matched_responses(stimuli: DataFrame, keys: DataFrame, entity: str, ts: str, low: str, high: str, late: str) -> DataFrame:
    """Stimulus-key pairs with the key strictly between `low` and `high` after the stimulus; state is bounded by the watermarks."""
    s = stimuli.withWatermark(ts, late).select(F.col(entity).alias("s_entity"), F.col(ts).alias("s_ts"), F.col("code").alias("s_code"))
    k = keys.withWatermark(ts, late).select(F.col(entity).alias("k_entity"), F.col(ts).alias("k_ts"), F.col("code").alias("k_code"))
    return s.join(k, F.expr(f"s_entity = k_entity AND k_ts > s_ts + interval {low} AND k_ts < s_ts + interval {high}"))
