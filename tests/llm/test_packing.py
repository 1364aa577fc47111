import os
import random

import numpy as np
import pytest

from sigloom.llm import packing as P


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1025, 2000)
    x[:1500] //= 8
    x = np.maximum(x, 1)
    for docs, cost in ((256, 1024.0**2), (4, 1024.0**2), (256, 1024.0**2 / 4), (16, 1024.0**2 / 2)):
        b = P.best_fit(x, 1024, docs, cost)
        y = x.astype(float)
        longest = np.zeros(b.max() + 1)
        np.maximum.at(longest, b, y)
        assert np.bincount(b, weights=y).max() <= 1024 and np.bincount(b).max() <= docs
        assert (np.bincount(b, weights=y * y) <= [P.cost_limit(v, 1024, cost) for v in longest]).all()
    b = P.best_fit(x, 1024, 1024, 1024.0**2)
    assert np.bincount(b).size <= np.ceil(x.sum() / 1024) * 1.03 + 1


def test_both_further_capacities_bind():
    """With the defaults either limit alone gives other containers than none."""
    x = np.clip(np.random.default_rng(1).lognormal(5.2, 0.7, 4000).astype(int), 1, 1023)
    free = P.best_fit(x, 1024, 1024, 1024.0**2)
    docs = P.best_fit(x, 1024, P.MAX_DOCS, 1024.0**2)
    cost = P.best_fit(x, 1024, 1024, P.COST_SHARE * 1024**2)
    assert (np.bincount(free) > P.MAX_DOCS).any() and (docs != free).any() and (cost != free).any() and (cost != docs).any()
    y = x.astype(float)
    assert (np.bincount(free, weights=y * y) > P.COST_SHARE * 1024**2).sum() > (np.bincount(cost, weights=y * y) > P.COST_SHARE * 1024**2).sum()


def test_found_comes_from_packing(spark, monkeypatch):
    """p6_found lists what pack() split, not what is long."""
    from sigloom.llm import queries as Q
    from tests.conftest import SF

    want = {r.doc_id for r in Q.p6_found(spark, SF).collect()}
    assert want
    gone = min(want)
    whole = P.pack
    monkeypatch.setattr(P, "pack", lambda items, doc_id, *a, **k: whole(items.where(f"doc_id <> {gone}"), doc_id, *a, **k))
    assert {r.doc_id for r in Q.p6_found(spark, SF).collect()} == want - {gone}


def test_pack_keeps_every_piece(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 3, 50, 200, 700, 1023, 1024, 1025, 2048, 5000])) for i in range(700)] + [(9000, 0)]
    counts = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    ps = P.pieces(counts, "doc_id", 1024)
    out = P.pack(ps, "doc_id", 1024, task_pieces=200).collect()
    assert sorted((r.doc_id, r.piece_no, r.start_token, r.n_tokens) for r in out) == sorted(tuple(r) for r in ps.collect())
    by, docs = {}, {}
    for r in out:
        by[r.container_id] = by.get(r.container_id, 0) + r.n_tokens
        docs.setdefault(r.doc_id, 0)
        docs[r.doc_id] += r.n_tokens
    assert max(by.values()) <= 1024
    assert docs == {i: n for i, n in rows if n}
    assert all(r.piece_no == 0 for r in out if dict(rows)[r.doc_id] <= 1024)
    assert len(by) <= np.ceil(sum(n for _, n in rows) / 1024) * 1.08 + 2
    assert P.pack(ps.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        P.pack(ps, "doc_id", 1024, cost_share=0.0)


@pytest.mark.skipif(not os.path.exists(f"{P.TOKENIZERS}/{P.VOCABULARY}"), reason="no vocabulary files")
def test_token_counts(spark):
    rows = [(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (4, "word " * 60000, "x"), (None, "a", "x"), (5, "<|endoftext|>", "x")]
    got = {r.doc_id: r.n_tokens for r in P.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, doc string"), "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[4] >= 60000 and 3 not in got and len(got) == 4 and got[5] > 1
