"""Packing: every token placed once, no container over capacity, little room unused."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestitch.llm import packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(0, 50), max_size=40))
def test_plan_uses_each_length_exactly(histogram):
    runs = packing.plan(histogram, 256)
    used = Counter()
    for parts, repeats in runs:
        assert sum(parts) <= 256 and repeats > 0
        for n in parts:
            used[n] += repeats
    assert used == Counter({n: c for n, c in histogram.items() if c})


def test_plan_is_tight_and_small():
    histogram = {n: 2000 // n + 1 for n in range(20, 2000)}
    runs = packing.plan(histogram, 4096)
    total, boxes = sum(n * c for n, c in histogram.items()), sum(r for _, r in runs)
    assert total / (boxes * 4096) > 0.99
    scaled = packing.plan({n: c * 1000 for n, c in histogram.items()}, 4096)
    assert len(scaled) < 5 * len(histogram)


@pytest.mark.parametrize("centre,spread", [(5.0, 0.7), (6.5, 1.0)])
def test_patterns_place_short_items_too(centre, spread):
    rng = np.random.default_rng(1)
    histogram = Counter(np.clip(np.exp(rng.normal(centre, spread, 30_000)).astype(int), 1, 4096).tolist())
    boxes, least, used, by_patterns = packing.summary(histogram, 4096)
    assert by_patterns > 0.85 and used > 0.99 and boxes >= least


def test_the_fit_is_optimal_over_patterns_of_any_depth():
    rng = np.random.default_rng(2)
    counts = np.zeros(25)
    counts[3:12] = rng.integers(5, 60, 9)
    matrix, x = packing.nnls(counts, 24, packing.patterns(24, 2))
    weight = np.arange(25)
    residual = (counts - matrix.T @ x) * weight
    first = packing.best_pattern(counts * weight, 24)[0]
    assert (x >= 0).all() and matrix.sum(axis=1).max() > 2
    assert all(row @ residual <= 1e-3 * first for row in packing.patterns(24, 6))


def test_pack(spark):
    sizes = [0, None, 5, 5, 5, 10, 11, 25, 9, 1, 10]
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(sizes)], "id long, n long, piece string")
    rows = packing.pack(spark, df, "id", "n", 10).collect()
    boxes = Counter()
    placed = Counter()
    for r in rows:
        assert r.first_token == r.piece * 10
        if r.container_id is None:
            assert r.n_tokens == 0
        else:
            boxes[r.container_id] += r.n_tokens
            placed[r.id] += r.n_tokens
    assert max(boxes.values()) <= 10 and sorted(boxes) == list(range(len(boxes)))
    assert placed == Counter({k: n for k, n in enumerate(sizes) if n})
    assert len(boxes) == 9  # 81 tokens, no better is possible
    assert packing.pack(spark, df.limit(0), "id", "n", 10).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "é" * 3000)], "id long, text string")
    got = {r.id: r.n_tokens for r in tokens.with_token_count(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == pytest.approx(len(tokens.encoder().encode_ordinary("é" * 3000)))
