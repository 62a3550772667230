"""Recall against brute force, copies, unusable vectors."""

import numpy as np

from lodestitch.llm import similar_vectors as V

SCHEMA = "vec_id long, profile_id long, vec array<float>, created_at timestamp, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, p, v, None, "x") for i, p, v in rows], SCHEMA)


def profiles(spark):
    return spark.createDataFrame([(1, 48), (2, 16)], "id long, dimensions long")


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)  # several blocks per bucket
    monkeypatch.setattr(V, "SMALL", 100)
    monkeypatch.setattr(V, "COUNTED", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 48))
    x[300:450] = x[:150] + 0.25 * rng.normal(size=(150, 48))
    rows = [(k, 1, (v * (1 + k % 3)).tolist()) for k, v in enumerate(x)]
    unit = V.usable_vectors(frame(spark, rows), profiles(spark))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = y @ y.T
    np.fill_diagonal(cos, -2)
    got = {}
    for r in V.similar_vectors(spark, unit, k=10, recall=0.95).collect():
        got.setdefault(r.vec_id, {})[r.other_id] = r.cosine
    hits = sum(len(set(np.argsort(-cos[k])[:10]) & set(got[k])) for k in range(600))
    assert hits >= 0.9 * 6000
    assert all(abs(c - cos[a, b]) < 1e-5 for a, xs in got.items() for b, c in xs.items())
    near = {(r.vec_id, r.other_id) for r in V.similar_vectors(spark, unit, k=10, least=0.9).collect()}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(cos >= 0.9))}
    assert len(near & want) >= 0.99 * len(want) and near <= want


def test_recall_with_keys_of_several_rotations(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 32))
    x = centres[rng.integers(0, 30, 12_000)] + rng.normal(size=(12_000, 32))
    x[6000:6600] = x[:600] + 0.15 * rng.normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = V.plan(32, len(x), len(x), x[:4000].astype(np.float32), 0.9, 0.99)
    assert len(found.axes) >= 2 and found.probes >= 2
    df = spark.createDataFrame([(k, 3, v.tolist(), None, "x") for k, v in enumerate(x)], SCHEMA)
    profile = spark.createDataFrame([(3, 32)], "id long, dimensions long")
    near = {(r.vec_id, r.other_id) for r in V.similar_vectors(spark, V.usable_vectors(df, profile), k=10, least=0.9).collect()}
    want = set()
    for k in range(len(x)):
        cos = x @ x[k]
        cos[k] = -2
        top = np.argsort(-cos)[:10]
        want |= {(k, int(j)) for j in top if cos[j] >= 0.9}
    assert len(near & want) >= 0.97 * len(want)


def test_copies_and_unusable(spark):
    a, b = [1.0] * 16, [1.0] * 15 + [-1.0]
    rows = [(k, 2, a) for k in range(40)] + [(40, 2, b), (41, 2, None), (42, 2, []), (43, 2, [0.0] * 16), (44, 2, [float("nan")] * 16), (45, 1, a), (46, 9, a), (40, 2, b), (47, 2, [2.0] * 16), (48, None, a)]
    unit = V.usable_vectors(frame(spark, rows), profiles(spark))
    assert unit.count() == 42
    got = {}
    for r in V.similar_vectors(spark, unit, k=3).collect():
        got.setdefault(r.vec_id, []).append((r.position, r.other_id, round(r.cosine, 4)))
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert sorted(got[47]) == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]
    assert sorted(got[40]) == [(1, 0, 0.875), (2, 1, 0.875), (3, 2, 0.875)]
    assert len(got) == 42
    assert V.similar_vectors(spark, unit.limit(0)).count() == 0
