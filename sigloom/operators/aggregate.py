"""Condition means, counts, statistics by group, scaling and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small


def condition_mean(df: DataFrame, code: str, codes: list[int], keys: list[str], value: str) -> DataFrame:
    """Mean over trials by condition (AG1, AG2), for the given codes."""
    return df.where(F.col(code).isin(*codes)).groupBy(code, *keys).agg(F.avg(value).alias(value))


def grand_mean(df: DataFrame, code: str, keys: list[str], value: str) -> DataFrame:
    """Unweighted mean of the condition means (AG3): two levels, not a pooled mean."""
    return df.groupBy(code, *keys).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias(value))


def code_counts(df: DataFrame, keys: list[str], code: str, dim: DataFrame, dim_code: str, name: str) -> DataFrame:
    """(keys..., code, name, n) of the codes that occur (AG4)."""
    n = df.groupBy(*keys, code).agg(F.count("*").alias("n"))
    return n.join(broadcast_if_small(dim.select(F.col(dim_code).alias(code), name)), code)


def counts_by_condition(df: DataFrame, entity: str, code: str, codes: list[int]) -> DataFrame:
    """One column n_<code> for each condition (AG6)."""
    return df.groupBy(entity).agg(*[F.count_if(F.col(code) == c).alias(f"n_{c}") for c in codes])


def median_place(df: DataFrame, keys: list[str], xyz: tuple[str, str, str]) -> DataFrame:
    """Exact median of each coordinate (AG8)."""
    return df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in xyz])


def weight_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample std of absolute weights, the signed mean, and the count (AG9)."""
    a = F.abs(F.col(value))
    return df.groupBy(*keys).agg(F.avg(a).alias("mean_abs"), F.stddev_samp(a).alias("std_abs"), F.avg(value).alias("mean_signed"), F.count(value).alias("n"))


def signed_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of all, of positive and of negative values (AG10); null where a sign has none."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.sum(v).alias("sum_all"), F.sum(F.when(v > 0, v)).alias("sum_pos"), F.sum(F.when(v < 0, v)).alias("sum_neg"))


def real_share(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Share of real slots (AG14)."""
    return df.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("real_share"))


def extremes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Smallest, largest and largest absolute value (AG15)."""
    return df.groupBy(*keys).agg(F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.max(F.abs(F.col(value))).alias("max_abs"))


def minmax(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value scaled to [0, 1] over its group (AG16), null where the group is flat; an aggregate and a join, no window."""
    b = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")) if keys else df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = df.join(broadcast_if_small(b), keys) if keys else df.crossJoin(F.broadcast(b))  # one row
    return x.withColumn(value, F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] = ()) -> DataFrame:
    """(keys..., bin, n) of equal bins over [low, high] (AG17); values below or above count in the first or last bin."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)))).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact quartiles and the median (AG18)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(q.alias("_q")).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "q2", "q3"))])


def mean_std(df: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """Mean and population std (AG13)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_v"), F.stddev_pop(value).alias("std_v"), F.count(value).alias("n"))
