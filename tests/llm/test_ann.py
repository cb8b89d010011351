from itertools import product

import numpy as np
import pytest

from gridlens.llm import ann


def brute(rows, k, modulus):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % modulus == 0:
            near = sorted({(-float((q * x).sum()), j) for j, x in good if j != i})
            out.setdefault(i, []).append([(j, -s) for s, j in near[:k]])
    return out


@pytest.mark.parametrize("bits, d", [(3, 2), (2, 3)])
def test_hilbert_neighbours_touch(bits, d):
    grid = np.array(list(product(range(1 << bits), repeat=d)))
    keys = ann.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_odd_rows_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=3).astype(np.float32).tolist()) for i in range(1, 200)]
    rows += [(1000 + i, [1.0, 2.0, 2.0]) for i in range(300)]  # one vector that most rows share
    rows += [(40, None), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 1.0]), (100_000, [float("nan"), 1.0, 1.0]), (120_000, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 1.0])]
    rows += [(500, [9.0, 0.0, 0.0]), (500, [9.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as v", "1 as h1", "2 as score")
    got = {}
    for r in ann.search(frame, k=5, modulus=20).collect():
        got.setdefault(r.query_id, {}).setdefault(r["rank"], set()).add((r.vec_id, round(r.score, 9)))
    want = brute(rows, 5, 20)
    assert set(got) == set(want)
    for q, lists in want.items():
        assert [got[q][k + 1] for k in range(len(lists[0]))] == [{(j, round(s, 9))} for j, s in lists[0]]


def test_ties_go_to_the_least_ids(spark):
    """199 vectors of their own with one and the same product, which rounding of a matrix product must not part either."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(np.arange(1, 400))[:199]
    rows = [(int(i), [1.0, float(n), 0.0]) for n, i in enumerate(ids)] + [(1000, [2.0, 0.0, 0.0]), (2000, [0.0, 0.0, 5.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), modulus=1000).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found if r.query_id == 1000] == sorted(ids.tolist())[:20]
    assert {r.score for r in found if r.query_id == 1000} == {2.0}
    assert [r.vec_id for r in found if r.query_id == 2000] == sorted(ids.tolist())[:20]


def test_pieces_are_parted_beyond_the_cuts(spark, monkeypatch):
    monkeypatch.setattr(ann, "CUTS", 4)
    rng = np.random.default_rng(6)
    e = rng.normal(size=(3000, 8))
    index = ann.fit(e, float(np.sqrt((e * e).sum(1).max())), 3000, curves=2, stretch=32)
    there = index.stretches(e, False)
    assert index.fine > 1 and there.min() >= 0 and all(own.max() <= index.last(c) for c, own in enumerate(there))
    keys = index.keys(e, False)
    for c in range(2):
        assert (np.diff(there[c][np.argsort(keys[c], kind="stable")]) >= 0).all()


def test_recall(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    e = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in ann.search(spark.read.parquet(f"{data}/embeddings.parquet"), stretch=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = e @ e[q]
        s[q] = -9
        hit += len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
        total += 20
    assert hit / total >= 0.9


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(frame).collect()] == [(0, 1, 5, 0.5)]
    assert ann.search(frame.limit(0)).collect() == []


def test_stretches_widen_until_independent_vectors_are_found(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(4000, 24)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, stretch=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 4000, 20):
        s = e @ e[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / 4000 >= 0.9


def test_queries_of_a_stretch_in_several_groups_find_the_same(spark, data, monkeypatch):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    want = sorted(map(tuple, ann.search(frame, stretch=64, modulus=3).collect()))
    monkeypatch.setattr(ann, "ASKING", 7)
    assert sorted(map(tuple, ann.search(frame, stretch=64, modulus=3).collect())) == want
