"""Robust rank aggregation against a direct computation, champions against all pairs."""

import math
import random

import pytest

from lodestitch.llm import rank_fusion as R

SCORES = ["a", "b", "c"]
SCHEMA = "q long, i long, a double, b double, c double, rho string"


def key(v):
    return -math.inf if v is None or v != v else v


def make(seed):
    rnd = random.Random(seed)
    rows = []
    for q in range(4):
        for i in range(rnd.choice([1, 2, 30])):
            rows.append((q, i, *[rnd.choice([None, rnd.randrange(5) * 1.0, rnd.random() * 1e6, float("nan")]) for _ in SCORES], "x"))
    rows += rnd.sample(rows, 5) + [(None, 1, 1.0, 1.0, 1.0, "x"), (1, None, 1.0, 1.0, 1.0, "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_direct(spark, seed, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    rows = make(seed)
    ranking = R.robust_rank(spark, spark.createDataFrame(rows, SCHEMA), "q", "i", SCORES)
    got = {(r.q, r.i): (r.rho, r.mean_rank, r.position) for r in ranking.collect()}
    own = {(q, i): [key(x) for x in s] for q, i, *s, _ in rows if q is not None and i is not None}
    assert got.keys() == own.keys()
    for q in range(4):
        items = {i: s for (p, i), s in own.items() if p == q}
        rho = {}
        for i, s in items.items():
            ranks = sorted((sum(t[k] > s[k] for t in items.values()) + (sum(t[k] == s[k] for t in items.values()) + 1) / 2) / len(items) for k in range(3))
            beta = [sum(math.comb(3, j) * r**j * (1 - r) ** (3 - j) for j in range(k, 4)) for k, r in enumerate(ranks, 1)]
            rho[i] = (min(1.0, 3 * min(beta)), sum(ranks) / 3)
            assert got[q, i][:2] == pytest.approx(rho[i], abs=1e-9)
        assert sorted(got[q, i][2] for i in items) == list(range(1, len(items) + 1))
    wins = {(r.q, r.i) for r in R.ahead_of_all(spark, ranking, "q", "i", SCORES).collect()}
    sign = lambda x, y: (x > y) - (x < y)
    want = {(q, i) for (q, i), s in own.items() if all(sum(map(sign, s, t)) > 0 for (p, j), t in own.items() if p == q and j != i)}
    assert wins == want


def test_empty(spark):
    ranking = R.robust_rank(spark, spark.createDataFrame([], SCHEMA), "q", "i", SCORES)
    assert ranking.count() == 0
    assert R.ahead_of_all(spark, ranking, "q", "i", SCORES).count() == 0
