"""The super-subject: pseudo-trials of all subjects side by side, projected on a group PCA, drawn anew in every iteration.

Iterations and permutations never multiply the trials: a bucket of a few subjects is one Arrow call, which draws all
iterations from its trials in memory. Only what is summed over subjects leaves it: time x time Gram matrices for the
group PCA, and the projected pseudo-trials.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.decoding import GRIDS, classify, fit_logistic, folds, predict_logistic, tune_logistic
from sigloom.operators.ranking import hash_order
from sigloom.operators.spectral import as_series
from sigloom.session import input_partitions, materialise

#: Subjects of one bucket, at most about; a bucket's trials are in memory at once.
BUCKET_SUBJECTS = 8


def trial_series(trials: DataFrame) -> DataFrame:
    """(subj, trial, cond, ch_idx, series) of long trials (subj, trial, cond, ch_idx, t_idx, value), conditions 1 and 2.

    Subjects without two trials of either condition are left out: one is held out, and one must be left.
    """
    x = trials.where("cond in (1, 2)")
    n = x.select("subj", "cond", "trial").distinct().groupBy("subj").agg(F.count(F.when(F.col("cond") == 1, 1)).alias("a"), F.count(F.when(F.col("cond") == 2, 1)).alias("b"))
    s = as_series(x.join(n.where("a >= 2 and b >= 2").select("subj"), "subj"), ["subj", "trial", "cond", "ch_idx"], "t_idx", "value")
    return materialise(s)


def hold_outs(series: DataFrame, iterations: int) -> DataFrame:
    """(iter, subj, cond, trial): the trial of each condition that a subject holds out, first in hash order (WN3)."""
    iters = series.sparkSession.range(iterations).select(F.col("id").cast("int").alias("iter"))
    ids = series.select("subj", "cond", "trial").distinct().crossJoin(F.broadcast(iters))  # one row an iteration is the result's size
    h = F.min(F.struct(hash_order(F.col("iter").cast("string"), "subj", "trial").alias("h"), "trial"))
    return materialise(ids.groupBy("iter", "subj", "cond").agg(h.alias("m")).select("iter", "subj", "cond", F.col("m.trial").alias("trial")))


class Subject:
    """One subject's trials (n x channels x time) with their conditions."""

    def __init__(self, pdf: pd.DataFrame):
        self.channels = np.sort(pdf["ch_idx"].unique())
        ids = pdf[["trial", "cond"]].drop_duplicates().sort_values("trial")
        self.trial, self.cond = ids["trial"].to_numpy(), ids["cond"].to_numpy()
        at = {t: i for i, t in enumerate(self.trial.tolist())}
        width = max(map(len, pdf["series"]))
        self.x = np.zeros((len(ids), len(self.channels), width))
        for t, c, s in zip(pdf["trial"], np.searchsorted(self.channels, pdf["ch_idx"]), pdf["series"]):
            self.x[at[t], c, : len(s)] = s

    def train(self, held: dict[int, int]) -> np.ndarray:
        """Which trials are not held out; held is condition -> trial."""
        return ~np.isin(self.trial, list(held.values()))

    def means(self, use: np.ndarray, cond: np.ndarray) -> np.ndarray:
        """2 x channels x time means of the used trials, by given conditions."""
        return np.stack([self.x[use & (cond == c)].mean(0) for c in (1, 2)])

    def pseudo(self, held: dict[int, int], n_slots: int, method: str) -> tuple[np.ndarray, np.ndarray]:
        """((2 n_slots + 2) x channels x time, real share by condition): padded trials of 1, of 2, and the two held out (DC1)."""
        use, rows, share = self.train(held), [], []
        for c in (1, 2):
            own = self.x[use & (self.cond == c)][:n_slots]
            if method == "duplicate":
                rows.append(own[np.arange(n_slots) % len(own)])
            else:
                rows.append(np.concatenate([own, np.repeat(self.x[use & (self.cond == c)].mean(0, keepdims=True), n_slots - len(own), 0)]))
            share.append(len(own) / n_slots)
        rows.append(np.stack([self.x[self.trial == held[c]][0] for c in (1, 2)]))
        return np.concatenate(rows), np.array(share)


def _held(pdf: pd.DataFrame) -> dict[tuple[int, int], dict[int, int]]:
    out: dict[tuple[int, int], dict[int, int]] = {}
    for i, s, c, t in zip(pdf["iter"], pdf["subj"], pdf["cond"], pdf["trial"]):
        out.setdefault((int(i), int(s)), {})[int(c)] = int(t)
    return out


def _permuted(subject: Subject, use: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The conditions, dealt again among the used trials."""
    cond = subject.cond.copy()
    cond[use] = np.random.default_rng(seed).permutation(cond[use])
    return cond


def _group_rows(subject: Subject, number: int, i: int, j: int, held: dict[int, int], method: str) -> np.ndarray:
    """A subject's channel rows of the group PCA: condition means in line or averaged, centred; perm j > 0 deals labels again."""
    use = subject.train(held)
    m = subject.means(use, subject.cond if j == 0 else _permuted(subject, use, (i, j, number)))
    rows = np.concatenate(list(m), axis=1) if method == "concat" else m.mean(0)
    return rows - rows.mean(1, keepdims=True)


def super_features(
    series: DataFrame, held: DataFrame, perms: int = 0, components: int = 3, pca: str = "concat", padding: str = "mean", n_slots: int = 23, given: dict[int, list[float]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(features, weights) of the super-subject (DC3) in every iteration of hold_outs().

    features is (iter, perm, compo, row, series): rows 0 to 2 n_slots - 1 are the pseudo-trials of condition 1, then of
    2, and the last two the held-out trials; each is the sum over subjects and channels of weight x value. weights is
    (iter, perm, compo, subj, weights, real_share). perm 0 fits the group PCA on the means of the true conditions, each
    further one on conditions dealt again among a subject's training trials. `given` (channel -> weights) replaces the PCA.
    """
    if pca not in ("concat", "mean") or padding not in ("mean", "duplicate"):
        raise ValueError((pca, padding))
    n_subjects = series.select("subj").distinct().count()
    buckets = max(min(input_partitions(series), n_subjects), -(-n_subjects // BUCKET_SUBJECTS), 1)
    bucket = F.pmod(F.xxhash64("subj"), F.lit(buckets)).cast("int")
    left = series.withColumn("bucket", bucket)
    right = held.withColumn("bucket", bucket)

    def subjects(pdf: pd.DataFrame) -> Iterator[tuple[int, Subject]]:
        for s, g in pdf.groupby("subj"):
            yield int(s), Subject(g)

    def gram(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        of, sums = _held(b), {}
        for s, subject in subjects(a):
            for i in sorted(i for i, q in of if q == s):
                for j in range(perms + 1):
                    m = _group_rows(subject, s, i, j, of[i, s], pca)
                    sums[i, j] = sums.get((i, j), 0.0) + m.T @ m
        rows = [(i, j, k, r.tolist()) for (i, j), m in sums.items() for k, r in enumerate(m)]
        return pd.DataFrame(rows, columns=["iter", "perm", "i", "row"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        val, u = np.linalg.eigh(np.array(pdf["row"].tolist()))
        rows = []
        for c, o in enumerate(np.argsort(-val)[:components]):
            v = u[:, o] * (1 if u[np.abs(np.round(u[:, o], 9)).argmax(), o] > 0 else -1)
            rows.append((int(pdf["iter"].iloc[0]), int(pdf["perm"].iloc[0]), c, (v / np.sqrt(val[o])).tolist() if val[o] > 1e-10 * max(val.max(), 1e-300) else np.zeros(len(v)).tolist()))
        return pd.DataFrame(rows, columns=["iter", "perm", "compo", "lift"])

    right = right.select("bucket", "iter", "subj", "cond", "trial")
    if given is None:
        part = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(gram, "iter int, perm int, i int, row array<double>")
        each = part.select("iter", "perm", "i", F.posexplode("row").alias("j", "v")).groupBy("iter", "perm", "i", "j").agg(F.sum("v").alias("v"))
        lifts = materialise(as_series(each, ["iter", "perm", "i"], "j", "v", "row").groupBy("iter", "perm").applyInPandas(solve, "iter int, perm int, compo int, lift array<double>"))
        to_all = series.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        lifts = lifts.crossJoin(F.broadcast(to_all))  # a few rows an iteration and bucket, whatever the trials
        right = right.select("*", F.lit(None).cast("int").alias("perm"), F.lit(None).cast("int").alias("compo"), F.lit(None).cast("array<double>").alias("lift")).unionByName(lifts, allowMissingColumns=True)

    def project(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        lift: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        if given is None:
            for i, j, c, v in zip(*(b[b["lift"].notna()][k] for k in ("iter", "perm", "compo", "lift"))):
                lift.setdefault((int(i), int(j)), {})[int(c)] = np.asarray(v)
            b = b[b["lift"].isna()]
        of, sums, rows = _held(b), {}, []
        for s, subject in subjects(a):
            for i in sorted(i for i, q in of if q == s):
                x, share = subject.pseudo(of[i, s], n_slots, padding)
                for j in range(perms + 1):
                    if given is None:
                        m = _group_rows(subject, s, i, j, of[i, s], pca)
                        w = np.stack([m @ lift[i, j][c] for c in sorted(lift[i, j])])
                    else:
                        w = np.array([given.get(int(c), [0.0] * components) for c in subject.channels], dtype=float).T
                    sums[i, j] = sums.get((i, j), 0.0) + np.einsum("kc,rct->krt", w, x)
                    rows += [(i, j, k, -1, s, v.tolist(), float(share.mean())) for k, v in enumerate(w)]
        for (i, j), y in sums.items():
            rows += [(i, j, k, r, None, v.tolist(), None) for k, m in enumerate(y) for r, v in enumerate(m)]
        return pd.DataFrame(rows, columns=["iter", "perm", "compo", "row", "subj", "series", "real_share"]).astype({"subj": "Int64"})

    got = materialise(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(project, "iter int, perm int, compo int, row int, subj bigint, series array<double>, real_share double"))
    long = got.where("row >= 0").select("iter", "perm", "compo", "row", F.posexplode("series").alias("t_idx", "v"))
    keys = ["iter", "perm", "compo", "row"]
    features = materialise(as_series(long.groupBy(*keys, "t_idx").agg(F.sum("v").alias("v")), keys, "t_idx", "v"))
    return features, got.where("row = -1").select("iter", "perm", "compo", "subj", F.col("series").alias("weights"), "real_share")


def _labels(n_slots: int) -> np.ndarray:
    return np.repeat([1, 2], n_slots)


def scaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by the training rows' mean and population deviation by feature (DC18)."""
    m, s = train.mean(0), train.std(0)
    s = np.where(s > 0, s, 1)
    return (train - m) / s, (test - m) / s


RUN = "accuracy double, log_loss double, pred_1 int, pred_2 int, p2_1 double, p2_2 double"


def _score(w: np.ndarray, test: np.ndarray) -> tuple:
    p = predict_logistic(w, test)
    pred = (p > 0.5) + 1
    own = np.clip([1 - p[0], p[1]], 1e-15, 1 - 1e-15)
    return float((pred == [1, 2]).mean()), float(-np.log(own).mean()), int(pred[0]), int(pred[1]), float(p[0]), float(p[1])


def tuned(features: DataFrame, grid: tuple[float, ...], scale: bool = False, n_slots: int = 23, k: int = 5) -> DataFrame:
    """(compo, c): the regularisation with the best cross-validated accuracy on iteration 0, which all iterations use."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("row")["series"].tolist())
        x, _ = scaled(x[:-2], x[-2:]) if scale else (x[:-2], None)
        return pd.DataFrame({"compo": [int(pdf["compo"].iloc[0])], "c": [float(tune_logistic(x, _labels(n_slots), grid, k))]})

    return features.where("iter = 0 and perm = 0").groupBy("compo").applyInPandas(run, "compo int, c double")


def decode_iterations(features: DataFrame, perms: int = 0, refit_pca: bool = False, grid: tuple[float, ...] = (0.01, 0.1, 1, 10, 100), scale: bool = False, n_slots: int = 23) -> DataFrame:
    """(compo, iter, perm, c, accuracy, log_loss, pred_1, pred_2, p2_1, p2_2) of one logistic fit a row (DC5, DC6, DC13, DC15).

    Features are time points; the two held-out rows are scored. perm 0 has the true labels, the others labels dealt
    again, on perm 0's features or, with refit_pca, on their own.
    """
    c_of = materialise(tuned(features, grid, scale, n_slots))
    x = features.where("perm = 0") if not refit_pca else features

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, compo, c = int(pdf["iter"].iloc[0]), int(pdf["compo"].iloc[0]), float(pdf["c"].iloc[0])
        by = {int(j): np.array(g.sort_values("row")["series"].tolist()) for j, g in pdf.groupby("perm")}
        rows = []
        for j in range(perms + 1):
            m = by[j if refit_pca else 0]
            train, test = scaled(m[:-2], m[-2:]) if scale else (m[:-2], m[-2:])
            y = _labels(n_slots) if j == 0 else np.random.default_rng((i, j)).permutation(_labels(n_slots))
            rows.append((compo, i, j, c, *_score(fit_logistic(train, y, c), test)))
        return pd.DataFrame(rows, columns=["compo", "iter", "perm", "c", "accuracy", "log_loss", "pred_1", "pred_2", "p2_1", "p2_2"])

    return x.join(F.broadcast(c_of), "compo").groupBy("compo", "iter").applyInPandas(run, f"compo int, iter int, perm int, c double, {RUN}")  # one row a component


def stability(weights: DataFrame) -> DataFrame:
    """(compo, mean_cor): mean absolute rank correlation of the PCA weights of each two iterations (CC4), perm 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array([np.concatenate(g.sort_values("subj")["weights"].tolist()) for _, g in pdf.groupby("iter")])
        r = pd.DataFrame(m).rank(axis=1).to_numpy()
        cor = np.abs(np.corrcoef(r)) if len(r) > 1 else np.ones((1, 1))
        low = cor[np.tril_indices(len(r), -1)]
        return pd.DataFrame({"compo": [int(pdf["compo"].iloc[0])], "mean_cor": [float(low.mean()) if len(low) else None]})

    return weights.where("perm = 0").groupBy("compo").applyInPandas(run, "compo int, mean_cor double")


def stratified_folds(y: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Fold number of each row, in like numbers of either label."""
    rng, out = np.random.default_rng(seed), np.zeros(len(y), dtype=int)
    for c in np.unique(y):
        at = rng.permutation(np.flatnonzero(y == c))
        out[at] = np.arange(len(at)) % k
    return out


def _per_time(draws: list[np.ndarray], n_slots: int, grid: tuple[float, ...], k: int, seed: int) -> tuple[float, float, float]:
    """(c, mean, std of accuracy) over draws, each (rows x features) with two held-out rows at the end."""
    y = _labels(n_slots)
    c = tune_logistic(draws[0][:-2], y, grid, k, of=stratified_folds(y, k, seed))
    acc = [_score(fit_logistic(m[:-2], y, c), m[-2:])[0] for m in draws]
    return c, float(np.mean(acc)), float(np.std(acc))


def decode_times(features: DataFrame, together: bool = False, grid: tuple[float, ...] = (0.01, 0.1, 1, 10), n_slots: int = 23, k: int = 3, seed: int = 0) -> DataFrame:
    """([compo,] t_idx, c, accuracy, accuracy_std): one model a time point, tuned on iteration 0 (DC7; DC8 with `together`).

    Features are one component's value, or with `together` those of all components.
    """
    x = features.where("perm = 0").select("iter", "compo", "row", F.posexplode("series").alias("t_idx", "v"))
    keys = ["t_idx"] if together else ["compo", "t_idx"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cube = pdf.pivot_table(index=["iter", "row"], columns="compo", values="v").sort_index()
        draws = [g.to_numpy() for _, g in cube.groupby(level=0)]
        return pd.DataFrame([(*[int(pdf[q].iloc[0]) for q in keys], *_per_time(draws, n_slots, grid, k, seed))], columns=[*keys, "c", "accuracy", "accuracy_std"])

    return x.groupBy(*keys).applyInPandas(run, ", ".join(f"{q} int" for q in keys) + ", c double, accuracy double, accuracy_std double")


def _raw_draws(a: pd.DataFrame, b: pd.DataFrame, n_slots: int, padding: str) -> list[np.ndarray]:
    """Pseudo-trials of each iteration with all subjects' channels as features, from one time point's values (DC4)."""
    of = _held(b)
    subjects = [(int(s), Subject(g)) for s, g in a.groupby("subj")]
    return [np.concatenate([q.pseudo(of[i, s], n_slots, padding)[0][:, :, 0] for s, q in subjects], axis=1) for i in sorted({i for i, _ in of})]


def _by_time(series: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = series.select("subj", "trial", "cond", "ch_idx", F.posexplode("series").alias("t_idx", "v")).withColumn("series", F.array("v")).drop("v")
    return x, held.crossJoin(F.broadcast(x.select((F.col("t_idx") + 0).alias("t_idx")).distinct()))  # as many rows as time points


def decode_times_raw(series: DataFrame, held: DataFrame, grid: tuple[float, ...] = (0.01, 0.1, 1, 10), n_slots: int = 23, padding: str = "mean", k: int = 3, seed: int = 0) -> DataFrame:
    """(t_idx, c, accuracy, accuracy_std): one model a time point, features are all subjects' channels (DC8 on DC4)."""
    x, h = _by_time(series, held)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(a["t_idx"].iloc[0]), *_per_time(_raw_draws(a, b, n_slots, padding), n_slots, grid, k, seed))], columns=["t_idx", "c", "accuracy", "accuracy_std"])

    return x.groupBy("t_idx").cogroup(h.groupBy("t_idx")).applyInPandas(run, "t_idx int, c double, accuracy double, accuracy_std double")


def generalisation(rows: DataFrame, keys: list[str], k: int, n_slots: int = 23, c: float = 1.0, seed: int = 42, stride: int = 1) -> DataFrame:
    """(keys..., t_train, t_test, accuracy) by k-fold over training and held-out rows alike (DC9, DC10).

    rows is (keys..., t_idx, row, x) with an array of features a row, of one draw. Each training time is a task that
    fits once a fold; each test time is a task that gets all the fitted models: T x k fits, and no task holds two times.
    """
    rows = materialise(rows.where(F.col("t_idx") % stride == 0))
    y = np.concatenate([_labels(n_slots), [1, 2]])
    f = folds(len(y), k, seed)
    ks = ", ".join(f"{q} {rows.schema[q].dataType.simpleString()}" for q in keys)
    head = f"{ks}, " if keys else ""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("row")["x"].tolist())
        own = [(*[pdf[q].iloc[0] for q in keys], int(pdf["t_idx"].iloc[0]), n, fit_logistic(x[f != n], y[f != n], c).tolist()) for n in range(k)]
        return pd.DataFrame(own, columns=[*keys, "t_train", "fold", "w"])

    models = materialise(rows.groupBy(*keys, "t_idx").applyInPandas(fit, f"{head}t_train int, fold int, w array<double>"))
    times = rows.select(*keys, (F.col("t_idx") + 0).alias("t_idx")).distinct()
    to_all = models.join(times, keys) if keys else models.crossJoin(times)  # every model meets every time, by definition

    def ask(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = np.array(a.sort_values("row")["x"].tolist())
        out = []
        for t, g in b.groupby("t_train"):
            acc = [((predict_logistic(np.asarray(w), x[f == n]) > 0.5) + 1 == y[f == n]).mean() for n, w in zip(g["fold"], g["w"])]
            out.append((*[a[q].iloc[0] for q in keys], int(t), int(a["t_idx"].iloc[0]), float(np.mean(acc))))
        return pd.DataFrame(out, columns=[*keys, "t_train", "t_test", "accuracy"])

    return rows.groupBy(*keys, "t_idx").cogroup(to_all.groupBy(*keys, "t_idx")).applyInPandas(ask, f"{head}t_train int, t_test int, accuracy double")


def component_rows(features: DataFrame) -> DataFrame:
    """(compo, t_idx, row, x) of iteration 0, one value a row (DC9)."""
    return features.where("perm = 0 and iter = 0").select("compo", F.posexplode("series").alias("t_idx", "v"), "row").select("compo", "t_idx", "row", F.array("v").alias("x"))


def raw_rows(series: DataFrame, held: DataFrame, n_slots: int = 23, padding: str = "mean") -> DataFrame:
    """(t_idx, row, x) of iteration 0 with all subjects' channels as features (DC10 on DC4)."""
    x, h = _by_time(series, held.where("iter = 0"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m = _raw_draws(a, b, n_slots, padding)[0]
        return pd.DataFrame({"t_idx": int(a["t_idx"].iloc[0]), "row": np.arange(len(m), dtype=np.int32), "x": m.tolist()})

    return x.groupBy("t_idx").cogroup(h.groupBy("t_idx")).applyInPandas(run, "t_idx int, row int, x array<double>")


def compare_models(features: DataFrame, n_slots: int = 23, k: int = 5, shuffled: bool = False, seed: int = 0) -> DataFrame:
    """(compo, model, setting, iter, accuracy, macro_f1) of five classifiers on the held-out trials (DC11).

    Every setting of every classifier is cross-validated on iteration 0, each in its own task; the best one (ties: the
    first) is used in all iterations. With `shuffled` the training labels are dealt again in each.
    """
    spark = features.sparkSession
    all_settings = spark.createDataFrame([(m, i) for m, g in GRIDS.items() for i in range(len(g))], "model string, setting int")
    x = features.where("perm = 0").select("compo", "iter", "row", "series")

    def labels(i: int) -> np.ndarray:
        return np.random.default_rng((seed, i)).permutation(_labels(n_slots)) if shuffled else _labels(n_slots)

    def tune(pdf: pd.DataFrame) -> pd.DataFrame:
        model, setting = pdf["model"].iloc[0], int(pdf["setting"].iloc[0])
        m = np.array(pdf.sort_values("row")["series"].tolist())[:-2]
        y, of = labels(0), stratified_folds(labels(0), k, seed)
        hit = sum(int((classify(model, GRIDS[model][setting], m[of != n], y[of != n], m[of == n]) == y[of == n]).sum()) for n in range(k))
        return pd.DataFrame([(int(pdf["compo"].iloc[0]), model, setting, hit)], columns=["compo", "model", "setting", "hit"])

    tried = x.where("iter = 0").crossJoin(F.broadcast(all_settings)).groupBy("compo", "model", "setting").applyInPandas(tune, "compo int, model string, setting int, hit int")  # 31 settings
    best = materialise(tried.groupBy("compo", "model").agg(F.min(F.struct((-F.col("hit")).alias("h"), "setting")).alias("m")).select("compo", "model", "m.setting"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, setting, i = pdf["model"].iloc[0], int(pdf["setting"].iloc[0]), int(pdf["iter"].iloc[0])
        m = np.array(pdf.sort_values("row")["series"].tolist())
        pred, y = classify(model, GRIDS[model][setting], m[:-2], labels(i), m[-2:]), np.array([1, 2])
        f1 = [2 * ((pred == q) & (y == q)).sum() / max((pred == q).sum() + 1, 1) for q in (1, 2)]
        return pd.DataFrame([(int(pdf["compo"].iloc[0]), model, setting, i, float((pred == y).mean()), float(np.mean(f1)))], columns=["compo", "model", "setting", "iter", "accuracy", "macro_f1"])

    schema = "compo int, model string, setting int, iter int, accuracy double, macro_f1 double"
    return x.join(F.broadcast(best), "compo").groupBy("compo", "model", "setting", "iter").applyInPandas(run, schema)  # five rows a component
