"""Lagged and rank correlation, recurrence, distances and dynamic time warping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small


#: Ranges of values within which average_rank() orders.
RANK_RANGES = 4096


def lag_correlation(pair: DataFrame, keys: list[str], idx: str, x: str, y: str, lags: range, wrap: bool = False) -> DataFrame:
    """(keys..., lag, corr, n): Pearson correlation of x with y moved by every lag (CC1).

    pair has both series side by side. Each y is exploded to the positions that the lags move it to and meets x in one
    equi-join, so a sweep of any lags costs one shuffle.
    """
    dim = F.explode(F.sequence(F.lit(lags.start), F.lit(lags.stop - 1), F.lit(lags.step)))
    moved = pair.select(*keys, F.col(y).alias("_y"), F.col(idx).alias("_j"), dim.alias("lag"))
    if wrap:
        n = pair.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else pair.agg(F.count("*").alias("_n"))
        moved = moved.join(broadcast_if_small(n), keys) if keys else moved.crossJoin(F.broadcast(n))  # one row
        moved = moved.withColumn("_i", F.pmod(F.col("_j") + F.col("lag"), F.col("_n")).cast("int"))
    else:
        moved = moved.withColumn("_i", (F.col("_j") + F.col("lag")).cast("int"))
    base = pair.select(*keys, F.col(idx).alias("_i"), F.col(x).alias("_x"))
    j = moved.join(base, [*keys, "_i"])
    return j.groupBy(*keys, "lag").agg(F.corr("_x", "_y").alias("corr"), F.count("*").alias("n"))


def best_lag(corrs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., lag, corr) with the largest signed correlation; ties go to the smallest lag (CC2)."""
    ok = corrs.where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    return ok.groupBy(*keys).agg(F.min(F.struct((-F.col("corr")).alias("m"), "lag")).alias("_m")).select(*keys, F.col("_m.lag").alias("lag"), (-F.col("_m.m")).alias("corr"))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean (CC4).

    Values are cut into equal ranges of each group and counted within a range; ranges are offset by the counts of those
    before. So no group is sorted as a whole, and equal values are one row before they are ordered.
    """
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANK_RANGES)
    n = n.join(broadcast_if_small(ends), keys).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.coalesce(at, F.lit(RANK_RANGES))).otherwise(0).cast("int"))
    n = n.withColumn("_b", F.when(F.isnan(F.col(value).cast("double")), RANK_RANGES + 1).otherwise(F.col("_b")))
    by = n.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    by = by.select(*keys, "_b", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(value)) - F.col("_c")
    ranks = n.withColumn("_in", within).join(broadcast_if_small(by), [*keys, "_b"]).select(*keys, value, (F.col("_before") + F.col("_in") + (F.col("_c") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, series: str, idx: str, value: str, keys: list[str] = (), include_self: bool = False) -> DataFrame:
    """(keys..., i, j, rho), i < j (or <=), of every two series over their common index (CC4-CC6)."""
    r = average_rank(df.where(F.col(value).isNotNull()), [*keys, series], value, "_r")
    a = r.select(*keys, F.col(series).alias("i"), F.col(idx).alias("_k"), F.col("_r").alias("_a"))
    b = r.select(*keys, F.col(series).alias("j"), F.col(idx).alias("_k"), F.col("_r").alias("_b"))
    j = a.join(b, [*keys, "_k"]).where("i <= j" if include_self else "i < j")
    return j.groupBy(*keys, "i", "j").agg(F.corr("_a", "_b").alias("rho"))


def stability(rhos: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean of the absolute non-zero correlations below the diagonal (CC4)."""
    a = F.abs(F.col("rho"))
    return rhos.where("i < j and rho <> 0").groupBy(*keys).agg(F.avg(a).alias("stability"), F.count("*").alias("n_pairs"))


def category(r: dict[str, Column]) -> Column:
    """Entity category from correlations r11 ... r33, in the order of precedence 1, 3, 2, 4 (CC7)."""
    return (
        F.when(F.abs(r["r11"]) >= 0.7, 1)
        .when(F.greatest(*[F.abs(r[k]) for k in ("r11", "r12", "r13")]) >= 0.6, 3)
        .when(F.greatest(*[F.abs(r[k]) for k in ("r21", "r22", "r23", "r31", "r32", "r33")]) >= 0.6, 2)
        .otherwise(4)
    )


def recurrence(df: DataFrame, keys: list[str], idx: str, value: str, n: int, eps: float = 0.1) -> DataFrame:
    """(keys..., i, j, distance, recurrent) for all i, j < n - 1 (CC8): the result itself is quadratic in one series' length.

    The inner side is a dictionary of one series a group, sent along as an array, so no cross join shuffles pairs.
    """
    x = df.where(F.col(idx) < n - 1)
    arr = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("j"), F.col(value).alias("v")))).alias("_s")) if keys else x.agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("j"), F.col(value).alias("v")))).alias("_s"))
    j = x.join(broadcast_if_small(arr), keys) if keys else x.crossJoin(F.broadcast(arr))  # one row
    e = j.select(*keys, F.col(idx).alias("i"), F.col(value).alias("_a"), F.explode("_s").alias("_p"))
    d = F.abs(F.col("_a") - F.col("_p.v"))
    return e.select(*keys, "i", F.col("_p.j").alias("j"), d.alias("distance"), (d < eps).alias("recurrent"))


def manhattan(df: DataFrame, key: str, vec: str, other: DataFrame) -> DataFrame:
    """Manhattan distances of every row to the rows of a stated, size-checked query set (CC11)."""
    o = other.select(F.col(key).alias("other"), F.col(vec).alias("_v"))
    x = df.join(broadcast_if_small(o), F.col(key) != F.col("other"))
    d = F.aggregate(F.zip_with(vec, "_v", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return x.select(key, "other", d.alias("distance"))


def dtw(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Euclidean dynamic time warping: distance and path (CC10)."""
    n, m = len(a), len(b)
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0
    d = (a[:, None] - b[None, :]) ** 2
    for s in range(2, n + m + 1):  # by anti-diagonal
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        c[i, j] = d[i - 1, j - 1] + np.minimum(np.minimum(c[i - 1, j], c[i, j - 1]), c[i - 1, j - 1])
    i, j, path = n, m, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        k = int(np.argmin([c[i - 1, j - 1], c[i - 1, j], c[i, j - 1]]))
        i, j = (i - 1, j - 1) if k == 0 else (i - 1, j) if k == 1 else (i, j - 1)
    return float(np.sqrt(c[n, m])), path[::-1]


def fill_gaps(df: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """Linear interpolation of inner nulls; outer ones take the nearest value (CC10)."""
    w = Window.partitionBy(*keys).orderBy(idx)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    prev = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = df.withColumn("_p", prev).withColumn("_n", nxt)
    lin = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(idx) - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))
    return x.withColumn(value, F.coalesce(F.col(value), F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(lin))).drop("_p", "_n")


def dtw_pairs(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys..., distance, path_length) of every row's two series (CC10)."""

    def run(it):
        for pdf in it:
            got = [dtw(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(pdf[a], pdf[b])]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "distance": [g[0] for g in got], "path_length": [len(g[1]) for g in got]})

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, a, b).mapInPandas(run, f"{schema}, distance double, path_length int")
