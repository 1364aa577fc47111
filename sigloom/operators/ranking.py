"""Thresholds, top-k, slots, seeded hold-outs and rolling blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small


def component_threshold(df: DataFrame, keys: list[str], value: str, replace: float | None = 0.0, strict: bool = False) -> DataFrame:
    """Weights below mean + population std of the signed weights (in absolute value) are replaced (WN9; WN10 with strict).

    Equality is kept, or replaced with strict=True. Adds thr.
    """
    t = df.groupBy(*keys).agg((F.avg(value) + F.abs(F.stddev_pop(value))).alias("thr"))
    a = F.abs(F.col(value))
    low = (a <= F.col("thr")) if strict else (a < F.col("thr"))
    return df.join(broadcast_if_small(t), keys).withColumn(value, F.when(low, F.lit(replace).cast("double")).otherwise(F.col(value)))


def top_by_abs(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the largest absolute value, ranked from 1; ties by `tie` (WN5)."""
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col(value)).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dominant(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys..., name, value) with the largest signed value; ties go to the first name (WN8, WN12)."""
    m = F.min(F.struct((-F.col(value)).alias("m"), F.col(name).alias("o")))
    return df.groupBy(*keys).agg(m.alias("_m")).select(*keys, F.col("_m.o").alias(name), (-F.col("_m.m")).alias(value))


def slots(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with slot, its position within the group from 1 (WN2)."""
    return df.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def hash_order(seed: Column | str | int, *cols: str) -> Column:
    """Reproducible random order: md5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(seed) if isinstance(seed, int) else seed, *[F.col(c).cast("string") for c in cols]))


def hold_out(df: DataFrame, keys: list[str], ids: list[str], seed: int | Column, k: int = 1) -> DataFrame:
    """The k rows of each group that come first in hash order (WN3, WN4), by aggregation for k = 1."""
    h = hash_order(seed, *ids)
    if k == 1:
        return df.groupBy(*keys).agg(F.min(F.struct(h.alias("_h"), *[i for i in ids if i not in keys])).alias("_m")).select(*keys, *[F.col(f"_m.{i}").alias(i) for i in ids if i not in keys])
    w = Window.partitionBy(*keys).orderBy(h, *ids)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def smallest(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The n rows with the smallest value (WN6): a top-k report."""
    return df.orderBy(by, tie).limit(n)


def rolling_blocks(df: DataFrame, idx: str, width: int, step: int, end: int) -> DataFrame:
    """Rows with every block (start) that holds them: starts 0, step, ... while start + width < end (WN13).

    A row's blocks follow from its index, so no range join is needed.
    """
    last = max((end - width - 1) // step, -1)
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - width + 1) / step)).cast("int")
    upto = F.least(F.lit(last), F.floor(F.col(idx) / step)).cast("int")
    return df.where(first <= upto).withColumn("block", F.explode(F.sequence(first, upto))).withColumn("start", (F.col("block") * step).cast("int")).drop("block")
