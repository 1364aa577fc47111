"""Decoding over pseudo-trials: slot padding, standardising, small classifiers, permutations and metrics.

Fits are tiny and many (tens of rows, hundreds of features, thousands of fits), so each runs as one Arrow call over a
group of rows; iterations, permutations, time points and models are rows of a parameter frame, not driver loops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.ranking import slots
from sigloom.session import broadcast_if_small


def pad(trials: DataFrame, entity: str, cond: str, trial: str, keys: list[str], value: str, n_slots: int = 23, method: str = "mean") -> DataFrame:
    """(entity, cond, slot, keys..., value, is_real): every condition filled to n_slots pseudo-trials (DC1, DC2).

    'mean' fills with the condition's mean, 'pooled' with the mean over both conditions, 'duplicate' repeats trials in
    order; further trials than slots are left out by definition of the slot count.
    """
    ids = slots(trials.select(entity, cond, trial).distinct(), [entity, cond], [trial]).where(F.col("slot") <= n_slots)
    count = ids.groupBy(entity, cond).agg(F.count("*").alias("_n"))
    grid = count.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n_slots))))
    x = trials.join(broadcast_if_small(ids), [entity, cond, trial])
    if method == "duplicate":
        grid = grid.withColumn("_src", ((F.col("slot") - 1) % F.col("_n") + 1).cast("int"))
        src = x.withColumnRenamed("slot", "_src")
        return src.join(broadcast_if_small(grid), [entity, cond, "_src"]).select(entity, cond, F.col("slot"), *keys, value, (F.col("slot") <= F.col("_n")).alias("is_real"))
    by = [entity, *keys] if method == "pooled" else [entity, cond, *keys]
    if method not in ("mean", "pooled"):
        raise ValueError(method)
    mean = trials.groupBy(*by).agg(F.avg(value).alias(value))
    if method == "pooled":
        mean = mean.join(broadcast_if_small(count.select(entity, cond)), entity)
    empty = grid.where(F.col("slot") > F.col("_n")).select(entity, cond, "slot")
    fill = mean.join(broadcast_if_small(empty), [entity, cond]).select(entity, cond, "slot", *keys, value, F.lit(False).alias("is_real"))
    return x.select(entity, cond, "slot", *keys, value, F.lit(True).alias("is_real")).unionByName(fill)


def standardise(train: DataFrame, test: DataFrame, feature: str, value: str) -> DataFrame:
    """Test rows scaled by the train rows' mean and population std of their feature (DC18); null where the std is 0."""
    m = train.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return test.join(broadcast_if_small(m), feature).withColumn(value, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def metrics(df: DataFrame, keys: list[str], y: str, pred: str, p2: str | None = None, eps: float = 1e-15) -> DataFrame:
    """Accuracy, F1 of label 1, macro F1 over labels 1 and 2, and log loss of P(2) (DC16)."""

    def f1(label: int) -> Column:
        tp = F.sum(F.when((F.col(y) == label) & (F.col(pred) == label), 1).otherwise(0))
        n = F.sum(F.when(F.col(y) == label, 1).otherwise(0)) + F.sum(F.when(F.col(pred) == label, 1).otherwise(0))
        return F.when(n > 0, 2.0 * tp / n).otherwise(0.0)

    aggs = [F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"), f1(1).alias("f1"), ((f1(1) + f1(2)) / 2).alias("macro_f1")]
    if p2:
        p = F.least(F.greatest(F.when(F.col(y) == 2, F.col(p2)).otherwise(1 - F.col(p2)), F.lit(eps)), F.lit(1 - eps))
        aggs.append((-F.avg(F.ln(p))).alias("log_loss"))
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], out: str) -> DataFrame:
    """df with the row number of each row within its keys, in the order of (bucket, order).

    Rows are ranked within a bucket only; buckets are offset by the counts of those before. So a group of any size is
    ranked by many tasks, if its buckets are many.
    """
    x = df.withColumn("_b", bucket)
    n = x.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    n = n.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return x.withColumn("_own", own).join(broadcast_if_small(n), [*keys, "_b"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def permuted_labels(df: DataFrame, id_: str, y: str, n: int, seed: int = 0, width: int = 65_536) -> DataFrame:
    """(perm, id, y_perm): labels dealt again in hash order, n times (DC6, DC14, DC19); ids are whole numbers.

    Both orders are numbered within a permutation (ids by ranges of `width`, hashes by their first digits), and labels
    meet rows in an equi-join on the number.
    """
    spark = df.sparkSession
    reps = spark.range(n).select(F.col("id").cast("int").alias("perm"))
    x = df.select(id_, y).crossJoin(F.broadcast(reps))  # n copies of the labels are the result itself
    x = x.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col(id_).cast("string"))))
    a = numbered(x.select("perm", id_), ["perm"], F.floor(F.col(id_) / width), [id_], "_r")
    b = numbered(x.select("perm", id_, "_h", F.col(y).alias("y_perm")), ["perm"], F.substring("_h", 1, 2), ["_h", id_], "_r")
    return a.join(b.select("perm", "_r", "y_perm"), ["perm", "_r"]).select("perm", id_, "y_perm")


def p_value(null: DataFrame, observed: DataFrame, keys: list[str], value: str, greater: bool = True) -> DataFrame:
    """(keys..., raw, corrected): share of null values at least (at most) as extreme, and (1 + count) / (1 + n) (DC17)."""
    o = observed.select(*keys, F.col(value).alias("_o"))
    x = null.join(broadcast_if_small(o), keys) if keys else null.crossJoin(F.broadcast(o))  # one row without keys
    hit = (F.col(value) >= F.col("_o")) if greater else (F.col(value) <= F.col("_o"))
    c, n = F.sum(hit.cast("int")), F.count("*")
    return x.groupBy(*keys).agg((c / n).alias("raw"), ((c + 1) / (n + 1)).alias("corrected")) if keys else x.agg((c / n).alias("raw"), ((c + 1) / (n + 1)).alias("corrected"))


# ---- kernels: numpy only, rows x features, labels 1 and 2 ----


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of L2 logistic regression by Newton's method.

    With more features than rows it is fitted in the rows' space, which holds the solution.
    """
    if x.shape[1] > x.shape[0]:
        u, s, v = np.linalg.svd(x, full_matrices=False)
        w = fit_logistic(u * s, y, c, rounds)
        return np.append(w[:-1] @ v, w[-1])
    z = np.hstack([x, np.ones((len(x), 1))])
    t = (y == 2).astype(float)
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], 1 / c)
    reg[-1] = 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - t) + reg * w
        h = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + np.diag(reg)
        s = np.linalg.solve(h, g)
        w = w - s
        if np.abs(s).max() < 1e-8:
            break
    return w


def predict_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_svm(k: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Dual coefficients of a kernel SVM without bias, by coordinate ascent (the kernel has 1 added instead)."""
    t = np.where(y == 2, 1.0, -1.0)
    q = (k + 1) * t[:, None] * t[None]
    a = np.zeros(len(y))
    for _ in range(rounds):
        old = a.copy()
        for i in range(len(y)):
            a[i] = np.clip(a[i] + (1 - q[i] @ a) / max(q[i, i], 1e-12), 0, c)
        if np.abs(a - old).max() < 1e-6:
            break
    return a * t


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def dtw_distances(s: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Dynamic time warping distance of a series to each row of `many`, by anti-diagonals over all rows at once."""
    n, m = len(s), many.shape[1]
    c = np.full((len(many), n + 1, m + 1), np.inf)
    c[:, 0, 0] = 0
    d = (s[None, :, None] - many[:, None, :]) ** 2
    for q in range(2, n + m + 1):
        i = np.arange(max(1, q - m), min(n, q - 1) + 1)
        j = q - i
        c[:, i, j] = d[:, i - 1, j - 1] + np.minimum(np.minimum(c[:, i - 1, j], c[:, i, j - 1]), c[:, i - 1, j - 1])
    return np.sqrt(c[:, n, m])


def knn_dtw(train: np.ndarray, y: np.ndarray, test: np.ndarray, k: int) -> np.ndarray:
    near = [y[np.argsort(dtw_distances(s, train), kind="stable")[:k]] for s in test]
    return np.array([2 if (q == 2).sum() * 2 > len(q) else 1 for q in near])


def forest(train: np.ndarray, y: np.ndarray, test: np.ndarray, trees: int = 100, depth: int | None = None, features: str = "sqrt", seed: int = 0) -> np.ndarray:
    """Majority of random trees on bootstrap samples, cut at quartiles."""
    rng = np.random.default_rng(seed)
    m = max(1, int(np.sqrt(train.shape[1]) if features == "sqrt" else np.log2(train.shape[1])))

    def gini(t: np.ndarray) -> float:
        two = (t == 2).sum()
        return 2 * two * (len(t) - two) / len(t)

    def grow(x, t, d):
        if d == 0 or len(t) < 2 or (t == t[0]).all():
            return float((t == 2).mean())
        best = None
        for f in rng.choice(x.shape[1], m, replace=False):
            for cut in np.quantile(x[:, f], (0.25, 0.5, 0.75)):
                left = x[:, f] <= cut
                if left.all() or not left.any():
                    continue
                g = gini(t[left]) + gini(t[~left])
                if best is None or g < best[0]:
                    best = (g, f, cut, left)
        if best is None:
            return float((t == 2).mean())
        _, f, cut, left = best
        return (f, cut, grow(x[left], t[left], d - 1), grow(x[~left], t[~left], d - 1))

    def ask(node, s):
        while isinstance(node, tuple):
            node = node[2] if s[node[0]] <= node[1] else node[3]
        return node

    votes = np.zeros(len(test))
    for _ in range(trees):
        b = rng.integers(len(train), size=len(train))
        node = grow(train[b], y[b], depth if depth else 64)
        votes += [ask(node, s) for s in test]
    return np.where(votes / trees > 0.5, 2, 1)


#: Settings that each classifier is tuned over. Fixed values.
GRIDS = {
    "logistic": [{"c": c} for c in (0.01, 0.1, 1, 10)],
    "linear_svm": [{"c": c} for c in (0.01, 0.1, 1, 10)],
    "rbf_svm": [{"c": c, "gamma": g} for c in (0.01, 0.1, 1, 10) for g in ("scale", "auto")],
    "forest": [{"trees": n, "depth": d, "features": f} for n in (50, 100) for d in (None, 5, 10) for f in ("sqrt", "log2")],
    "knn_dtw": [{"k": k} for k in (1, 3, 5)],
}


def classify(model: str, setting: dict, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the rows of b by a classifier fitted on a, y."""
    if (y == y[0]).all():
        return np.full(len(b), y[0])
    if model == "logistic":
        return (predict_logistic(fit_logistic(a, y, setting["c"]), b) > 0.5) + 1
    if model == "linear_svm":
        return (((b @ a.T + 1) @ fit_svm(a @ a.T, y, setting["c"])) > 0) + 1
    if model == "rbf_svm":
        g = 1 / (a.shape[1] * max(float(a.var()), 1e-12)) if setting["gamma"] == "scale" else 1 / a.shape[1]
        return (((rbf(b, a, g) + 1) @ fit_svm(rbf(a, a, g), y, setting["c"])) > 0) + 1
    if model == "forest":
        return forest(a, y, b, setting["trees"], setting["depth"], setting["features"])
    return knn_dtw(a, y, b, setting["k"])


def folds(n: int, k: int, seed: int) -> np.ndarray:
    """Fold number of each of n rows."""
    out = np.empty(n, dtype=int)
    out[np.random.default_rng(seed).permutation(n)] = np.arange(n) % k
    return out


def tune_logistic(x: np.ndarray, y: np.ndarray, grid: tuple[float, ...], k: int = 5, seed: int = 42, of: np.ndarray | None = None) -> float:
    """The C of the grid with the best cross-validated accuracy (over the given folds, if any); ties go to the smallest."""
    f = folds(len(y), k, seed) if of is None else of
    best = (-1.0, grid[0])
    for c in grid:
        hit = 0
        for i in range(k):
            tr, te = f != i, f == i
            if len(np.unique(y[tr])) < 2 or not te.any():
                continue
            hit += int(((predict_logistic(fit_logistic(x[tr], y[tr], c), x[te]) > 0.5) + 1 == y[te]).sum())
        if hit / len(y) > best[0]:
            best = (hit / len(y), c)
    return best[1]
