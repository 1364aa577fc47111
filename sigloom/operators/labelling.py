"""Sign-quadrant labels and clustering of weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small, materialise

#: Points of one block of silhouette().
SILHOUETTE_BLOCK = 2048
#: Rows of a group that select_clusters() takes into one task; Ward and spectral clustering hold a matrix of their square.
GROUP_ROWS = 20_000

# fixed values: quadrant label codes by the signs of two weights
QUADRANTS = {(1, 1): 0, (-1, 1): 1, (-1, -1): 2, (1, -1): 3, (-1, 0): 4, (0, 1): 5, (0, -1): 6, (1, 0): 7, (0, 0): 8}


def quadrant(a: Column, b: Column) -> Column:
    """Sign-quadrant code of two thresholded weights; null where either is null or NaN (CL1)."""
    out = F.lit(None).cast("int")
    for (x, y), c in QUADRANTS.items():
        out = F.when((F.signum(a) == x) & (F.signum(b) == y), F.lit(c)).otherwise(out)
    return out


def label_histogram(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows by keys and label, without the label of two zeros (CL2)."""
    return df.where(F.col(label) != 8).groupBy(*keys, label).agg(F.count("*").alias("n"))


def shared_labels(df: DataFrame, channel: str, band: str, label: str, least: int = 2) -> DataFrame:
    """(channel, label, n_bands, bands) of channels with one label in several bands (CL3)."""
    g = df.groupBy(channel, label).agg(F.countDistinct(band).alias("n_bands"), F.array_join(F.array_sort(F.collect_set(F.col(band).cast("string"))), ",").alias("bands"))
    return g.where(F.col("n_bands") >= least)


def silhouette(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """One row: mean of (b - a) / max(a, b) over all points, Euclidean; rows of clusters of one count as 0 (CL8).

    The definition needs all distances of a point. Points are cut into blocks of SILHOUETTE_BLOCK by hash; every two
    blocks are one task, which sums its distances by point and cluster, so no pair is ever a row.
    """
    p = df.select(F.col(key).cast("string").alias("k"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("string").alias("l"))
    blocks = max(1, -(-p.count() // SILHOUETTE_BLOCK))
    x = p.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.withColumn("lo", F.least("s", "o")).withColumn("hi", F.greatest("s", "o"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        sides = [(lo, hi)] if lo == hi else [(lo, hi), (hi, lo)]
        out = []
        for mine, other in sides:
            f, g = pdf[pdf["s"] == mine], pdf[pdf["s"] == other]
            if not len(f) or not len(g):
                continue
            a, b = np.array(f["v"].tolist()), np.array(g["v"].tolist())
            cluster, at = np.unique(g["l"].to_numpy(object), return_inverse=True)
            one = np.eye(len(cluster))[at]
            for i in range(0, len(a), 256):
                d = np.sqrt(np.maximum(((a[i : i + 256, None] - b[None]) ** 2).sum(-1), 0.0)) if a.shape[1] <= 16 else np.stack([np.sqrt(((r - b) ** 2).sum(1)) for r in a[i : i + 256]])
                total = d @ one
                for k, l, row in zip(f["k"].iloc[i : i + 256], f["l"].iloc[i : i + 256], total):
                    out += [(k, l, c, float(v)) for c, v in zip(cluster, row)]
        return pd.DataFrame(out, columns=["k", "l", "l2", "d"])

    by = x.groupBy("lo", "hi").applyInPandas(sums, "k string, l string, l2 string, d double").groupBy("k", "l", "l2").agg(F.sum("d").alias("d"))
    n = p.groupBy("l").agg(F.count("*").alias("n")).withColumnRenamed("l", "l2")
    by = by.join(broadcast_if_small(n), "l2")
    own = F.col("l") == F.col("l2")
    s = by.groupBy("k").agg(F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    return s.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def silhouette_np(x: np.ndarray, labels: np.ndarray) -> float:
    """The same for one small matrix."""
    sq = (x**2).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    u = np.unique(labels)
    if len(u) < 2:
        return -1.0
    means = np.stack([d[:, labels == c].sum(1) for c in u], 1)
    sizes = np.array([(labels == c).sum() for c in u])
    own = np.searchsorted(u, labels)
    n_own = sizes[own]
    a = np.where(n_own > 1, means[np.arange(len(x)), own] / np.maximum(n_own - 1, 1), np.nan)
    other = means / sizes
    other[np.arange(len(x)), own] = np.inf
    b = other.min(1)
    s = np.where(n_own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(np.nan_to_num(s).mean())


def kmeans(x: np.ndarray, k: int, seed: int = 0, tries: int = 5, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several seeded k-means++ runs."""
    rng = np.random.default_rng(seed)
    best, best_cost = np.zeros(len(x), dtype=int), np.inf
    for _ in range(tries):
        c = [x[rng.integers(len(x))]]
        while len(c) < k:
            d = np.min([((x - m) ** 2).sum(1) for m in c], axis=0)
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(c)
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            l = d.argmin(1)
            new = np.array([x[l == i].mean(0) if (l == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(1).sum()
        if cost < best_cost:
            best, best_cost = l, cost
    return best


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of Ward's agglomeration cut at k clusters (CL6, CL7), by Lance-Williams updates."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1).astype(float)
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    for _ in range(n - k):
        i, j = np.unravel_index(np.argmin(np.where(alive[:, None] & alive[None], d, np.inf)), d.shape)
        i, j = min(i, j), max(i, j)
        m = alive.copy()
        m[[i, j]] = False
        new = ((size[i] + size[m]) * d[i, m] + (size[j] + size[m]) * d[j, m] - size[m] * d[i, j]) / (size[i] + size[j] + size[m])
        d[i, m] = d[m, i] = new
        size[i] += size[j]
        alive[j] = False
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


def spectral(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Labels of spectral clustering with an RBF affinity (CL5)."""
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    a = np.exp(-d2 / max(np.median(d2), 1e-12))
    deg = 1 / np.sqrt(a.sum(1))
    _, v = np.linalg.eigh(deg[:, None] * a * deg[None])
    u = v[:, -k:]
    return kmeans(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k, seed)


METHODS = {"kmeans": lambda x, k: kmeans(x, k), "ward": ward, "spectral": lambda x, k: spectral(x, k)}


def select_clusters(df: DataFrame, keys: list[str], id_: str, cols: list[str], method: str, ks: range = range(2, 10)) -> DataFrame:
    """(keys..., id, cluster, k, silhouette): labels of the k with the best silhouette (CL4-CL7, WN12; ties: smallest k).

    A group is one weight matrix, of a few thousand channels, and one Arrow call. Ward's and spectral clustering need a
    matrix of its square, so a group of more than GROUP_ROWS rows raises ValueError. k-means is fitted on the GROUP_ROWS
    rows of a group with the smallest hashes, which is all of a smaller group, and then labels every row.
    """
    fn = METHODS[method]
    x = df.select(*keys, id_, *cols)
    largest = x.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > GROUP_ROWS and method != "kmeans":
        raise ValueError(f"a group of {largest} rows is too large for {method}: at most {GROUP_ROWS}")
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, id_])

    def best_of(m: np.ndarray) -> tuple[float, int, np.ndarray]:
        best = (-2.0, 0, np.zeros(len(m), dtype=int))
        for k in ks:
            if k >= len(m):
                break
            l = fn(m, k)
            s = silhouette_np(m, l)
            if s > best[0] + 1e-12:
                best = (s, k, l)
        return best

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        s, k, l = best_of(pdf[cols].to_numpy(float))
        out = pdf[[*keys, id_]].copy()
        out["cluster"], out["k"], out["silhouette"] = l.astype(int), k, s
        return out

    if largest <= GROUP_ROWS:
        return x.groupBy(*keys).applyInPandas(run, f"{schema}, cluster int, k int, silhouette double")

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values(id_)[cols].to_numpy(float)
        s, k, l = best_of(m)
        return pd.DataFrame([(*[pdf[q].iloc[0] for q in keys], c, k, s, m[l == c].mean(0).tolist()) for c in np.unique(l)], columns=[*keys, "cluster", "k", "silhouette", "centre"])

    share = x.groupBy(*keys).agg((F.lit(float(GROUP_ROWS)) / F.count("*")).alias("_p"))
    chosen = x.join(broadcast_if_small(share), keys).where(F.pmod(F.xxhash64(id_), F.lit(1 << 30)) < F.col("_p") * (1 << 30)).drop("_p")
    head = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    fitted = chosen.groupBy(*keys).applyInPandas(centres, f"{head}, cluster int, k int, silhouette double, centre array<double>")
    d = F.aggregate(F.zip_with(F.array(*[F.col(c).cast("double") for c in cols]), "centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    near = x.join(broadcast_if_small(materialise(fitted)), keys).groupBy(*keys, id_).agg(F.min(F.struct(d.alias("d"), "cluster", "k", "silhouette")).alias("m"))
    return near.select(*keys, id_, "m.cluster", "m.k", "m.silhouette")
