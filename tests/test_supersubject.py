import numpy as np
import pytest

from sigloom.operators import decoding as dc
from sigloom.operators import supersubject as su

SCHEMA = "subj int, trial int, cond int, ch_idx int, t_idx int, value double, iter int, perm int, row int"


def _trials(n_subj=5, n_trials=12, channels=3, t=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_subj):
        for k in range(n_trials):
            c = 1 + k % 2
            x = rng.normal(size=(channels, t)) + (c - 1.5) * np.sin(np.arange(t))
            rows += [(s, k, c, i, j, float(x[i, j]), 9, 9, 9) for i in range(channels) for j in range(t)]
    rows += [(99, 0, 1, 0, 0, 1.0, 9, 9, 9), (99, 1, 2, 0, 0, 1.0, 9, 9, 9), (98, 0, 3, 0, 0, 1.0, 9, 9, 9)]  # too few trials; no condition
    return rows


@pytest.fixture(scope="module")
def trials(spark):
    return spark.createDataFrame(_trials(), SCHEMA)


def _numpy(rows, held, pca):
    """Features of one iteration by plain numpy: held is (subj, cond) -> trial."""
    x = {}
    for s, k, c, i, j, v, *_ in rows:
        if s < 50:
            x.setdefault((s, k, c), np.zeros((3, 6)))[i, j] = v
    means, train, test = [], [], []
    for s in range(5):
        by = [np.stack([m for (q, k, c), m in sorted(x.items()) if q == s and c == cond and k != held[s, cond]]) for cond in (1, 2)]
        m = [b.mean(0) for b in by]
        means.append(np.concatenate(m, axis=1) if pca == "concat" else (m[0] + m[1]) / 2)
        train.append(np.concatenate([np.concatenate([b, np.repeat(b.mean(0)[None], 23 - len(b), 0)]) for b in by]))
        test.append(np.stack([x[s, held[s, c], c] for c in (1, 2)]))
    m = np.concatenate(means)
    m = m - m.mean(1, keepdims=True)
    u, _, _ = np.linalg.svd(m, full_matrices=False)
    both = np.concatenate([np.concatenate(train, axis=1), np.concatenate(test, axis=1)])  # (46 + 2) x channels x time
    return [np.einsum("c,rct->rt", u[:, k], both) for k in range(3)]


@pytest.mark.parametrize("pca", ["concat", "mean"])
def test_features_equal_numpy(spark, trials, pca):
    s = su.trial_series(trials)
    h = su.hold_outs(s, 2)
    held = {(r.iter, r.subj, r.cond): r.trial for r in h.collect()}
    assert len(held) == 20 and {q for _, q, _ in held} == set(range(5))
    f, w = su.super_features(s, h, pca=pca)
    got = {(r.iter, r.compo, r.row): np.array(r.series) for r in f.collect()}
    assert len(got) == 2 * 3 * 48
    for i in range(2):
        want = _numpy(_trials(), {(q, c): t for (j, q, c), t in held.items() if j == i}, pca)
        for k in range(3):
            mine = np.stack([got[i, k, r] for r in range(48)])
            assert min(np.abs(mine - want[k]).max(), np.abs(mine + want[k]).max()) < 1e-8
    assert all(abs(r.real_share - 5 / 23) < 1e-12 for r in w.collect())


def test_buckets_do_not_change_the_result(spark, trials, monkeypatch):
    s = su.trial_series(trials)
    h = su.hold_outs(s, 2)
    one = {(r.iter, r.perm, r.compo, r.row): np.array(r.series) for r in su.super_features(s, h, perms=1)[0].collect()}
    monkeypatch.setattr(su, "input_partitions", lambda df: 1)
    two = {(r.iter, r.perm, r.compo, r.row): np.array(r.series) for r in su.super_features(s, h, perms=1)[0].collect()}
    assert one.keys() == two.keys() and max(np.abs(one[k] - two[k]).max() for k in one) < 1e-8


def test_decoding_of_a_clear_effect(spark, trials):
    s = su.trial_series(trials)
    h = su.hold_outs(s, 4)
    f, w = su.super_features(s, h, perms=1)
    runs = su.decode_iterations(f, perms=1, refit_pca=True, scale=True).collect()
    assert len(runs) == 3 * 4 * 2
    assert np.mean([r.accuracy for r in runs if r.perm == 0 and r.compo == 0]) == 1.0
    assert su.stability(w).count() == 3
    t = su.decode_times(f).collect()
    assert len(t) == 18 and max(r.accuracy for r in t) == 1.0
    raw = su.decode_times_raw(s, h).collect()
    assert len(raw) == 6 and raw[0].c in (0.01, 0.1, 1, 10)
    g = su.generalisation(su.component_rows(f), ["compo"], 4).collect()
    assert len(g) == 3 * 36 and all(0 <= r.accuracy <= 1 for r in g)
    assert len(su.generalisation(su.raw_rows(s, h), [], 5, stride=5).collect()) == 4
    models = su.compare_models(f.where("compo = 0 and iter < 2"), k=3).collect()
    assert len(models) == 10 and all(r.accuracy == 1.0 for r in models if r.model in ("logistic", "linear_svm"))


def test_generalisation_equals_one_loop(spark, trials):
    s = su.trial_series(trials)
    f, _ = su.super_features(s, su.hold_outs(s, 1))
    x = np.stack([np.array(r.series) for r in sorted(f.where("compo = 1").collect(), key=lambda r: r.row)])
    y = np.concatenate([np.repeat([1, 2], 23), [1, 2]])
    of = dc.folds(48, 4, 42)
    for r in su.generalisation(su.component_rows(f).where("compo = 1"), ["compo"], 4).collect():
        a, b = x[:, [r.t_train]], x[:, [r.t_test]]
        acc = [((dc.predict_logistic(dc.fit_logistic(a[of != k], y[of != k]), b[of == k]) > 0.5) + 1 == y[of == k]).mean() for k in range(4)]
        assert abs(np.mean(acc) - r.accuracy) < 1e-12


def test_logistic_with_more_features_than_rows():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 30)), rng.integers(1, 3, 20)
    z = np.hstack([x, np.ones((20, 1))])
    w = dc.fit_logistic(x, y, 0.5)
    p = 1 / (1 + np.exp(-(z @ w)))
    grad = z.T @ (p - (y == 2)) + np.append(w[:-1] / 0.5, 0.0)
    assert np.abs(grad).max() < 1e-6  # the optimum of the full problem


def test_dtw_of_many_equals_one_by_one():
    from sigloom.operators.correlation import dtw

    rng = np.random.default_rng(2)
    s, many = rng.normal(size=9), rng.normal(size=(7, 11))
    assert np.allclose(dc.dtw_distances(s, many), [dtw(s, m)[0] for m in many])


def test_empty(spark, trials):
    s = su.trial_series(trials.limit(0))
    h = su.hold_outs(s, 2)
    f, w = su.super_features(s, h)
    assert h.count() == f.count() == w.count() == su.decode_iterations(f).count() == 0
