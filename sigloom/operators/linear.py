"""Decomposition and projection: PCA by a distributed Gram matrix, NMF, back-projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.spectral import as_series
from sigloom.session import broadcast_if_small


def gram(vectors: DataFrame, keys: list[str], vec: str = "series") -> DataFrame:
    """(keys..., i, row): the T x T Gram matrix of each group's centred channel rows.

    Channels may be far more than time points, so the channel x channel matrix is never built: every task adds up its
    channels' outer products, and one aggregation adds the tasks' rows.
    """
    cols = [*keys, vec]

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in it:
            for k, g in pdf.groupby(keys, sort=False, dropna=False):
                x = np.array(g[vec].tolist(), dtype=float)
                x = x - x.mean(1, keepdims=True)
                k = k if isinstance(k, tuple) else (k,)
                m = x.T @ x
                sums[k] = m if k not in sums else sums[k] + m
        rows = [(*k, i, r.tolist()) for k, m in sums.items() for i, r in enumerate(m)]
        yield pd.DataFrame(rows, columns=[*keys, "i", "row"])

    ks = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    part = vectors.select(*cols).mapInPandas(partial, f"{ks}, i int, row array<double>")
    each = part.select(*keys, "i", F.posexplode("row").alias("j", "v")).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    return as_series(each, [*keys, "i"], "j", "v", "row")


def pca(df: DataFrame, keys: list[str], channel: str, idx: str, value: str, k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, scores, explained) of samples = time points and features = channels (LA1, LA2, LA3, LA5, LA10).

    components (keys..., compo, channel, weight), scores (keys..., compo, idx, score), explained (keys..., compo, ratio).
    Channels are centred over time, not scaled; each component's largest absolute weight is positive (ties: the first
    channel). Groups with fewer than k dimensions give fewer components.
    """
    vec = as_series(df, [*keys, channel], idx, value)
    g = gram(vec, keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        m = np.array(pdf["row"].tolist())
        val, u = np.linalg.eigh(m)
        order = np.argsort(-val)[:k]
        total = max(val[val > 0].sum(), 1e-300)
        rows = [(c + 1, float(val[o] / total), (u[:, o] * np.sqrt(val[o])).tolist(), (u[:, o] / np.sqrt(val[o])).tolist()) for c, o in enumerate(order) if val[o] > 1e-10 * max(val.max(), 1e-300)]
        out = pd.DataFrame(rows, columns=["compo", "ratio", "scores", "lift"])
        for n in keys:
            out.insert(0, n, pdf[n].iloc[0])
        return out[[*keys, "compo", "ratio", "scores", "lift"]]

    ks = ", ".join(f"{n} {vec.schema[n].dataType.simpleString()}" for n in keys)
    eig = g.groupBy(*keys).applyInPandas(solve, f"{ks}, compo int, ratio double, scores array<double>, lift array<double>")
    mean = F.aggregate("series", F.lit(0.0), lambda s, x: s + x) / F.size("series")
    w = vec.withColumn("_m", mean).join(broadcast_if_small(eig), keys)
    dot = F.aggregate(F.zip_with(F.transform("series", lambda x: x - F.col("_m")), "lift", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    raw = w.select(*keys, "compo", F.col(channel), dot.alias("weight"))
    big = raw.groupBy(*keys, "compo").agg(F.min(F.struct((-F.round(F.abs(F.col("weight")), 9)).alias("m"), F.col(channel), "weight")).alias("_b"))
    sign = big.select(*keys, "compo", F.when(F.col("_b.weight") < 0, -1.0).otherwise(1.0).alias("_s"))
    components = raw.join(broadcast_if_small(sign), [*keys, "compo"]).select(*keys, "compo", channel, (F.col("weight") * F.col("_s")).alias("weight"))
    scores = eig.join(broadcast_if_small(sign), [*keys, "compo"]).select(*keys, "compo", "_s", F.posexplode("scores").alias(idx, "v")).select(*keys, "compo", idx, (F.col("v") * F.col("_s")).alias("score"))
    return components, scores, eig.select(*keys, "compo", "ratio")


def nmf(df: DataFrame, keys: list[str], channel: str, idx: str, value: str, k: int = 3, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(components, scores) of the NMF of min-max scaled channels (LA4), one Arrow call a group.

    components (keys..., compo, channel, weight, error), scores (keys..., compo, idx, score). Multiplicative updates from
    a fixed start, so results repeat; error is the relative reconstruction error.
    """
    vec = as_series(df, [*keys, channel], idx, value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(channel)
        x = np.array(pdf["series"].tolist(), dtype=float)
        lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
        x = np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0.0).T
        rng = np.random.default_rng(0)
        w, h = rng.random((x.shape[0], k)) + 0.1, rng.random((k, x.shape[1])) + 0.1
        for _ in range(rounds):
            h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
            w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
        err = float(np.linalg.norm(x - w @ h) / max(np.linalg.norm(x), 1e-12))
        head = [pdf[n].iloc[0] for n in keys]
        return pd.DataFrame([(*head, c + 1, err, pdf[channel].tolist(), h[c].tolist(), w[:, c].tolist()) for c in range(k)], columns=[*keys, "compo", "error", "_ch", "_h", "_w"])

    ks = ", ".join(f"{n} {vec.schema[n].dataType.simpleString()}" for n in keys)
    got = vec.groupBy(*keys).applyInPandas(run, f"{ks}, compo int, error double, _ch array<{vec.schema[channel].dataType.simpleString()}>, _h array<double>, _w array<double>")
    each = got.select(*keys, "compo", "error", F.explode(F.arrays_zip("_ch", "_h")).alias("_p"))
    return each.select(*keys, "compo", F.col("_p._ch").alias(channel), F.col("_p._h").alias("weight"), "error"), got.select(*keys, "compo", F.posexplode("_w").alias(idx, "score"))


def project(df: DataFrame, weights: DataFrame, on: list[str], out: list[str], value: str, weight: str = "weight") -> DataFrame:
    """Sum of weight x value over the channels (LA6, LA7, LA8, JN12): uncentred, grouped by `out`; weights' size is checked."""
    return df.join(broadcast_if_small(weights), on).groupBy(*out).agg(F.sum(F.col(weight) * F.col(value)).alias("score"))


def trajectory(scores: DataFrame, keys: list[str], idx: str, a: int = 1, b: int = 2) -> DataFrame:
    """(keys..., idx, x, y): two components side by side as a path (LA11)."""
    c = F.col("compo")
    return scores.where(c.isin(a, b)).groupBy(*keys, idx).agg(F.max(F.when(c == a, F.col("score"))).alias("x"), F.max(F.when(c == b, F.col("score"))).alias("y"))


def polar(df: DataFrame, keys: list[str], channel: str, value: str, n_channels: int) -> DataFrame:
    """(keys..., x, y): weights as arrows at equal angles, summed (LA9; data behind the polar views)."""
    theta = 2 * F.pi() * F.col(channel) / n_channels
    return df.groupBy(*keys).agg(F.sum(F.col(value) * F.cos(theta)).alias("x"), F.sum(F.col(value) * F.sin(theta)).alias("y"))
