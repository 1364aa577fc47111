"""Boundary semantics of the reference operators, on hand-written rows."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import dims
from sigloom.operators import aggregate as ag
from sigloom.operators import audio, correlation as cc, decoding as dc, events as ev, labelling as cl, linear as la, montage as mo, ranking as rk, shaping as sh, spectral as sp
from sigloom.sources import readers


def test_response_edges(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 1.0, 2), (2, 3, 0.0, 1), (3, 4, 0.0, 2)], "subj int, event_id int, t double, code int")
    k = spark.createDataFrame([(1, 10, 0.1, 49), (1, 11, 5.0, 50), (1, 12, 2.0, 49), (1, 13, 3.0, 50), (3, 14, 0.5, 48)], "subj int, event_id int, t double, code int")
    m = {r.event_id: r for r in ev.first_response(s, k, "subj", "t", 0.1, 5.0, "event_id").collect()}
    assert m[1].key_code == 49 and m[1].key_t == 2.0  # 0.1 is too early, the first of two wins
    assert m[2].key_code == 49 and m[3].key_code is None  # one key serves two stimuli; none
    o = {r.event_id: r.c for r in ev.first_response(s, k, "subj", "t", 0.1, 5.0, "event_id").select("event_id", ev.outcome(F.col("code"), F.col("key_code")).alias("c")).collect()}
    assert o == {1: 1, 2: 102, 3: 1, 4: 202}


def test_inclusion_limits(spark):
    rows = [(1, 1)] * 6 + [(1, 2)] * 6 + [(1, 101)] * 12 + [(2, 1)] * 12 + [(2, 2)] * 11 + [(3, 1)] * 5 + [(3, 2)] * 19
    got = {r.subj for r in ev.inclusion(spark.createDataFrame(rows, "subj int, code int"), "subj", "code").collect()}
    assert got == {1}  # exactly half is kept; 23 trials and less than half are not


def test_threshold_keeps_equality(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 1.0)], "k int, w double")
    assert sorted(r.w for r in rk.component_threshold(df, ["k"], "w").collect()) == [-1.0, 1.0]
    assert [r.w for r in rk.component_threshold(df, ["k"], "w", None, strict=True).collect()] == [None, None]


def test_grid_matches_stated_lengths():
    assert len(sh.hopping_grid(-1.5, 3301, 600.0, 0.025, 0.1)) == 217
    assert len(sh.hopping_grid(-0.5, 2701, 600.0, 0.025, 0.1)) == 177


def test_regions_first_match(spark):
    a = spark.createDataFrame([(x,) for x in ("MFG", "IFS", "HPC", "PHC", "WM")], "area string")
    got = {r.area: r.region for r in mo.region_first_match(a, "area", dims.regions(spark)).collect()}
    assert got == {"MFG": "premotor", "IFS": "DLPFC", "HPC": "MTL", "PHC": "MTL", "WM": None}


def test_band_members_overlap(spark):
    m = dims.band_members(spark)
    assert m.where("freq = 4").count() == 2 and m.where("freq = 110").count() == 0
    assert dims.frequencies(spark).count() == 38


def test_pairs_stay_on_their_shaft(spark):
    c = spark.createDataFrame([(1, 1, "A1", 0.0, 0.0, 0.0), (1, 2, "A3", 2.0, 0.0, 0.0), (1, 3, "B1", 0.0, 0.0, 0.0)], "subj int, ch_idx int, channel string, x double, y double, z double")
    got = mo.bipolar_pairs(c, "subj", "ch_idx", "channel").collect()
    assert [(r.pair, r.x) for r in got] == [("A1_A3", 1.0)]


def test_shift_wrap_and_lags(spark):
    df = spark.createDataFrame([(1, i, float(v), float(v)) for i, v in enumerate([1, 5, 2, 7, 3])], "k int, i int, x double, y double")
    got = {r.i: r.x for r in sh.shift(df.drop("y"), ["k"], "i", "x", -2, wrap=True).collect()}
    assert got == {3: 1.0, 4: 5.0, 0: 2.0, 1: 7.0, 2: 3.0}
    best = cc.best_lag(cc.lag_correlation(df, ["k"], "i", "x", "y", range(-2, 3)), ["k"]).collect()[0]
    assert best.lag == 0 and abs(best["corr"] - 1) < 1e-12


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 20))
    df = spark.createDataFrame([(1, c, t, float(x[c, t])) for c in range(6) for t in range(20)], "e int, ch int, t int, v double")
    comp, scores, expl = la.pca(df, ["e"], "ch", "t", "v", 3)
    z = x - x.mean(1, keepdims=True)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    ratio = s**2 / (s**2).sum()
    assert np.allclose([r.ratio for r in expl.orderBy("compo").collect()], ratio[:3])
    w = np.zeros((3, 6))
    for r in comp.collect():
        w[r.compo - 1, r.ch] = r.weight
    assert np.allclose(np.abs(w @ u[:, :3]), np.eye(3), atol=1e-8)
    assert all(w[i, np.abs(w[i]).argmax()] > 0 for i in range(3))
    got = np.zeros((3, 20))
    for r in scores.collect():
        got[r.compo - 1, r.t] = r.score
    assert np.allclose(got, w @ z, atol=1e-8)


def test_nmf_reconstructs(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((8, 2)) @ rng.random((2, 30)))
    df = spark.createDataFrame([(1, c, t, float(x[c, t])) for c in range(8) for t in range(30)], "e int, ch int, t int, v double")
    assert la.nmf(df, ["e"], "ch", "t", "v")[0].first().error < 0.1


def test_morlet_peaks_at_its_frequency_and_filters():
    t = np.arange(400) / 200
    p = sp.morlet_power(np.sin(2 * np.pi * 20 * t), 200, [10, 20, 40], [7, 7, 7])[:, 100:300].mean(1)
    assert p.argmax() == 1
    y = sp.fir_filter(np.sin(2 * np.pi * 50 * np.arange(1200) / 600) + np.sin(2 * np.pi * 7 * np.arange(1200) / 600), 600, notches=[50])
    assert np.corrcoef(y[200:1000], np.sin(2 * np.pi * 7 * np.arange(1200) / 600)[200:1000])[0, 1] > 0.99
    assert np.allclose(sp.resample(np.cos(2 * np.pi * 2 * np.arange(60) / 60), 20), np.cos(2 * np.pi * 2 * np.arange(20) / 20), atol=1e-9)
    assert sh.line_harmonics(300, 50) == [50, 100, 150, 200, 250]


def test_fir_equals_direct_convolution_and_has_its_gains():
    rng = np.random.default_rng(3)
    for n in (2, 5, 40, 200):
        x, taps = rng.normal(size=n), rng.normal(size=31)
        mirrored = np.pad(x, 15, mode="reflect", reflect_type="odd")
        assert np.allclose(sp.fir_apply(x, taps), np.convolve(mirrored, taps, mode="valid"))
    assert np.allclose(sp.fir_apply(np.array([2.0]), np.ones(3)), [2.0])
    high, notch = sp.fir_taps(600.0, 0.1, [50.0])
    assert len(high) == 19801 and len(notch) == 1981
    gain = lambda h, f: abs(np.sum(h * np.exp(-2j * np.pi * f / 600 * np.arange(len(h)))))
    assert gain(high, 0) < 1e-6 and abs(gain(high, 0.5) - 1) < 0.01 and abs(gain(high, 100) - 1) < 0.01
    assert gain(notch, 50) < 0.02 and all(abs(gain(notch, f) - 1) < 0.01 for f in (0, 47, 53, 200))


def test_silhouette_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, l = rng.normal(size=(90, 5)), rng.integers(0, 4, 90)
    l[0] = 9  # a cluster of one
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, l))], "k int, v array<double>, l int")
    for block in (2048, 25):
        monkeypatch.setattr(cl, "SILHOUETTE_BLOCK", block)
        assert abs(cl.silhouette(df, "k", "v", "l").first()[0] - cl.silhouette_np(x, l)) < 1e-9


def test_group_guard(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.1 + c for c in ([0, 0], [5, 5], [0, 5])])
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "g string, i int, a double, b double")
    whole = {r.i: r.cluster for r in cl.select_clusters(df, ["g"], "i", ["a", "b"], "kmeans").collect()}
    monkeypatch.setattr(cl, "GROUP_ROWS", 60)
    part = {r.i: r.cluster for r in cl.select_clusters(df, ["g"], "i", ["a", "b"], "kmeans").collect()}
    assert len(part) == 120 and len({(whole[i], part[i]) for i in whole}) == 3
    for method in ("ward", "spectral"):
        with pytest.raises(ValueError):
            cl.select_clusters(df, ["g"], "i", ["a", "b"], method)


def test_average_rank_of_ties_nulls_and_infinities(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", v) for v in (3.0, 1.0, 1.0, -2.0, 3.0, 3.0)] + [("b", 5.0)] * 3 + [("c", v) for v in (1.0, inf, -inf, nan, nan, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = sorted((r.k, str(r.v), r.r) for r in cc.average_rank(df, ["k"], "v", "r").collect())
    want = [("a", "-2.0", 1.0), ("a", "1.0", 2.5), ("a", "1.0", 2.5), *[("a", "3.0", 5.0)] * 3, *[("b", "5.0", 2.0)] * 3, ("c", "-inf", 1.0), ("c", "1.0", 2.0), ("c", "2.0", 3.0), ("c", "inf", 4.0), *[("c", "nan", 5.5)] * 2]
    assert got == sorted(want)


def test_dtw():
    d, path = cc.dtw(np.array([0.0, 1, 2]), np.array([0.0, 0, 1, 2]))
    assert d == 0 and path[0] == (0, 0) and path[-1] == (2, 3)


def test_classifiers_separate():
    rng = np.random.default_rng(0)
    y = np.repeat([1, 2], 30)
    x = rng.normal(size=(60, 5)) + y[:, None] * 2
    assert ((dc.predict_logistic(dc.fit_logistic(x, y), x) > 0.5) + 1 == y).mean() > 0.9
    k = dc.rbf(x, x, 0.2)
    assert ((((k + 1) @ dc.fit_svm(k, y)) > 0) + 1 == y).mean() > 0.9
    assert (dc.forest(x, y, x) == y).mean() > 0.9
    assert dc.tune_logistic(x, y, (0.1, 1.0)) in (0.1, 1.0)


def test_clustering_finds_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (15, 2)) for m in (0, 3, 6)])
    true = np.repeat([0, 1, 2], 15)
    for f in cl.METHODS.values():
        l = f(x, 3)
        assert all(len(set(l[true == c])) == 1 for c in range(3)) and len(set(l)) == 3
        assert cl.silhouette_np(x, l) > 0.8


def test_padding(spark):
    df = spark.createDataFrame([(1, 1, t, 0, float(t)) for t in (3, 5)] + [(1, 2, 7, 0, 9.0)], "subj int, cond int, trial int, t int, v double")
    got = {(r.cond, r.slot): (r.v, r.is_real) for r in dc.pad(df, "subj", "cond", "trial", ["t"], "v", 3).collect()}
    assert got == {(1, 1): (3.0, True), (1, 2): (5.0, True), (1, 3): (4.0, False), (2, 1): (9.0, True), (2, 2): (9.0, False), (2, 3): (9.0, False)}
    dup = {(r.cond, r.slot): r.v for r in dc.pad(df, "subj", "cond", "trial", ["t"], "v", 3, "duplicate").collect()}
    assert dup[(1, 3)] == 3.0


def test_sources(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([0, 5, -7], dtype=np.int16).tobytes())
    got = readers.read_wav(spark, str(tmp_path / "a.wav")).orderBy("sample_idx").collect()
    assert [(r.file, r.rate, r.amp) for r in got] == [("a.wav", 8000, 0), ("a.wav", 8000, 5), ("a.wav", 8000, -7)]
    df = spark.createDataFrame([("[<DigPoint | 1 : (-1.5, 2.25, 3.0) mm>]",)], "p string").select(*readers.decimals(F.col("p")))
    assert tuple(df.first()) == (-1.5, 2.25, 3.0)
    (tmp_path / "sub-01_info.json").write_text('{"chnames": ["A1"], "event_id": ["1", "x"]}')
    i = readers.read_info(spark, str(tmp_path / "sub-01_info.json"))
    assert i.first().subj == "sub-01" and [r.code for r in readers.exploded_codes(i, ["subj"]).collect()] == [1, None]
    out = str(tmp_path / "t")
    a = spark.createDataFrame([("s1", 1.0)], "subj string, v double")
    readers.write_missing(a, out, "subj")
    readers.write_missing(a.union(spark.createDataFrame([("s2", 2.0)], "subj string, v double")), out, "subj")
    assert spark.read.parquet(out).count() == 2


def test_audio(spark):
    x = np.zeros(300)
    x[100] = 1000
    y = np.zeros(300)
    y[140] = 1000
    rows = [(f, i, float(v)) for f, s in (("r", x), ("b", y)) for i, v in enumerate(s)]
    got = {r.file: r.delay for r in audio.peak_delay(spark.createDataFrame(rows, "file string, i int, a double"), "file", "i", "a", "r").collect()}
    assert got == {"r": 0, "b": -40}
    assert abs(sum(audio.savgol_weights()) - 1) < 1e-9


def test_quartiles_and_scaling(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(5)] + [(2, 3.0)], "k int, v double")
    assert {r.k: (r.q1, r.q2, r.q3) for r in ag.quartiles(df, ["k"], "v").collect()}[1] == (1.0, 2.0, 3.0)
    assert [r.v for r in ag.minmax(df, ["k"], "v").where("k = 2").collect()] == [None]


def test_streaming_forms(spark, tmp_path):
    from sigloom.streaming import live

    spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:30", 3.0)], "k int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = live.windowed_mean(s, ["k"], "ts", "v", "1 minute", "1 minute", "1 minute").writeStream.format("memory").queryName("live_means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.v, r.n) for r in spark.table("live_means").collect()] == [(2.0, 2)]


def test_decoding_queries_cover_all_iterations(spark):
    from sigloom.plans import reference_queries as rq
    from tests.conftest import SF

    models = rq.compare_classifiers(spark, SF).collect()
    assert {(x.iter, x.model) for x in models} == {(i, m) for i in range(100) for m in dc.GRIDS} and len(models) == 500
    runs = rq.permutation_final(spark, SF).collect()
    assert {(x.compo, x.iter, x.perm) for x in runs} == {(c, i, p) for c in range(3) for i in range(100) for p in range(2)} and len(runs) == 600


def test_whole_queries_leave_nothing_out(spark):
    from sigloom.plans import reference_queries as rq
    from tests.conftest import SF

    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = cl.silhouette_np(np.array(e["embedding"].tolist(), dtype=float), e["label"].to_numpy())
    assert abs(rq.silhouette(spark, SF).first()[0] - want) < 1e-4
    w = spark.read.parquet(f"{SF}/grp_concat_compo_pca3.parquet").toPandas()
    assert rq.unpivot_weights(spark, SF).count() == int(w.filter(like="ch_").notna().to_numpy().sum())
    c = spark.read.parquet(f"{SF}/coords.parquet").dropna(subset=["x", "y", "z"]).select("coord_id", "x", "y", "z").distinct()
    points = {tuple(x) for x in c.collect()}
    assert any(abs(v) >= 1000 for p in points for v in p[1:]) and any(abs(v) < 0.01 for p in points for v in p[1:])
    assert {tuple(x) for x in rq.printed_points(spark, SF).collect()} == points
    derived = {(x.coord_id, x.x_um, x.y_um, x.z_um) for x in rq.derive_columns(spark, SF).collect()}
    assert {x[0] for x in derived} == {p[0] for p in points} and max(abs(x[1]) for x in derived) >= 1e6
    one = spark.createDataFrame([("<point : (1.5E-4, -2.0E7, 3.25) mm>",)], "p string").select(*readers.decimals(F.col("p"))).first()
    assert tuple(one) == (1.5e-4, -2e7, 3.25)
