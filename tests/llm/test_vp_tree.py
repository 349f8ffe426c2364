from __future__ import annotations

import numpy as np
import pytest

from tollbook.llm import vp_tree

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, query_id string"


def brute(rows, k):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in sound:
        if q % 5 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in sound if i != q and len(y) == len(x))
            out += [(q, n, i, s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.fixture
def rows():
    rng = np.random.default_rng(1)
    made = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    made += [(300 + i, [1.0] * 8) for i in range(40)]  # equal vectors: ties go to the smaller id
    made += [(400, None), (401, []), (402, [0.0] * 8), (403, [None] + [1.0] * 7), (404, [float("nan")] * 8), (None, [1.0] * 8), (405, [1.0, 2.0]), (410, [2.0, 2.0])]
    return made


def test_exact_search(spark, rows, monkeypatch):
    monkeypatch.setattr(vp_tree, "SHARD_VECTORS", 120)
    monkeypatch.setattr(vp_tree, "BLOCK_QUERIES", 16)
    frame = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vp_tree.nearest(frame, frame.where("vec_id % 5 = 0"), k=4).collect())
    want = brute(rows, 4)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert vp_tree.nearest(frame, frame).count() == 0


def test_relaxed_search_prunes_and_keeps_most():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(20, 3)) * 10, 100, 0) + rng.normal(size=(2000, 3))
    ids = np.arange(2000)
    tree = vp_tree.Tree.build(ids, x)
    exact, found, all_taken = tree.search(x[:50], ids[:50], 10, 1.0)
    far = vp_tree.distances(x[:50], x)
    far[np.arange(50), np.arange(50)] = np.inf
    np.testing.assert_array_equal(found, np.argsort(far, axis=1, kind="stable")[:, :10])
    _, near, taken = tree.search(x[:50], ids[:50], 10, 2.0)
    assert taken < all_taken < far.size / 2
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, near, strict=True)]) > 0.9
