"""The random forest: held-out accuracy, determinism, degenerate samples."""

import numpy as np

from lodestitch.llm import forest


def make(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5) | (np.abs(x[:, 5]) > 1.8)).astype(float)
    return x, y


def test_held_out_accuracy():
    x, y = make(1, 3000)
    model = forest.fit(x, y, 40, 8, 3)
    a, b = make(2, 2000)
    votes = model.votes(a)
    assert ((votes >= 0.5) == b).mean() > 0.93 and votes.min() >= 0 and votes.max() <= 1
    again = forest.fit(x, y, 40, 8, 3)
    assert (again.votes(a) == votes).all()


def test_rows_without_a_feature_are_told_from_rows_with_little():
    rng = np.random.default_rng(4)
    x = np.concatenate((np.zeros((20, 3)), rng.uniform(0.001, 0.02, size=(60, 3)), rng.uniform(0.02, 1, size=(2000, 3))))
    y = np.concatenate((np.zeros(20), np.ones(60), np.zeros(2000)))
    votes = forest.fit(x, y, 40, 6, 5).votes(x)
    assert votes[:20].max() < 0.3 and votes[20:80].mean() > 0.8


def test_degenerate_samples():
    x = np.zeros((5, 2))
    assert (forest.fit(x, np.ones(5), 3, 3, 1).votes(x) >= 0).all()
    model = forest.fit(x, np.array([0.0, 1, 0, 1, 0]), 5, 3, 1)
    assert (model.feature == -1).all()
    assert len(model.votes(np.zeros((0, 2)))) == 0
