"""Pointer doubling against walking up each node."""

import random
from datetime import datetime, timedelta

import pytest

from lodestitch.operators import skew
from lodestitch.operators.hierarchy import artifact_links, descendants, intervals, resolve_hierarchy

VIEWS = "id long, supersedes long, superseded_by long, exported_at timestamp, created_at timestamp, name string, path string"
T0 = datetime(2024, 1, 1)


def walk(parents: dict) -> dict:
    out = {}
    for n in parents:
        path, at = [n], parents[n]
        while at is not None and len(path) <= len(parents):
            path.append(at)
            at = parents[at]
        out[n] = None if at is not None else path[::-1]
    return out


def check(spark, parents: dict) -> None:
    links = spark.createDataFrame(list(parents.items()), "id long, parent long")
    rows = {r.id: r for r in resolve_hierarchy(spark, links, paths=True).collect()}
    want = walk(parents)
    assert rows.keys() == want.keys()
    for n, path in want.items():
        r = rows[n]
        if path is None:
            assert (r.root_id, r.depth, r.in_cycle, r.path) == (-1, -1, True, None)
        else:
            assert (r.root_id, r.depth, r.in_cycle, r.path) == (path[0], len(path) - 1, False, path)
    labels = intervals(spark, resolve_hierarchy(spark, links))
    firsts: dict = {}
    for r in labels.collect():
        assert r.last - r.first == r.n_descendants
        firsts.setdefault(r.root_id, []).append(r.first)
    assert all(sorted(f) == list(range(len(f))) for f in firsts.values())  # each place once, from 0
    pairs = sorted(map(tuple, descendants(labels).collect()))
    assert pairs == sorted((a, p[-1], len(p) - 1 - k) for p in want.values() if p for k, a in enumerate(p[:-1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    rnd = random.Random(seed)
    parents = {n: rnd.choice([None, *range(40)]) if rnd.random() < 0.9 else None for n in range(40)}
    check(spark, parents)


def test_chain_star_and_self_loop(spark):
    parents = {0: None} | {n: n - 1 for n in range(1, 70)} | {n: 69 for n in range(70, 120)} | {200: 200, 201: 200}
    check(spark, parents)


def test_empty_table(spark):
    links = spark.createDataFrame([], "id long, parent long")
    assert resolve_hierarchy(spark, links).count() == 0
    assert descendants(intervals(spark, resolve_hierarchy(spark, links))).count() == 0


def test_hot_parent_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 5)
    check(spark, {0: None, 1: 0} | {n: 1 for n in range(2, 60)})


def test_links_of_views(spark):
    rows = [
        (1, None, 2, T0, T0, "a", "p"),
        (1, None, 2, T0, T0, "a", "p"),  # repeated
        (2, 99, None, T0 + timedelta(1), T0, "b", "p"),  # names a missing row: the other side counts
        (2, 1, None, T0, T0, "b", "p"),
        (3, 1, None, T0, T0, None, None),
        (4, 3, None, T0, T0, "d", "p"),
        (4, None, None, T0 - timedelta(1), T0, "d", "p"),  # outdated export
        (None, 1, 4, T0, T0, "x", "p"),
        (5, None, 77, None, None, "e", "p"),
    ]
    links = artifact_links(spark.createDataFrame(rows, VIEWS))
    assert sorted(map(tuple, links.collect())) == [(1, None), (2, 1), (3, 1), (4, 3), (5, None)]


def test_all_descendants_of_every_artifact(spark, tmp_path):
    from __spark_entry__ import queries

    parents = {n: n - 1 for n in range(41, 55)} | {40: None, 60: 50, 61: 60, 70: 71, 71: 70, 72: 71}
    rows = [(n, p, None, T0, T0, "a", "p") for n, p in parents.items()] + [(40, None, None, T0 - timedelta(1), T0, "a", "p")]
    spark.createDataFrame(rows, VIEWS).write.parquet(f"{tmp_path}/artifact_views.parquet")
    got = sorted(map(tuple, queries()["p1_all_descendants"](spark, str(tmp_path)).collect()))
    assert got == sorted((a, p[-1], len(p) - 1 - k) for p in walk(parents).values() if p for k, a in enumerate(p[:-1]))
    assert sorted(map(tuple, queries()["p1_descendants"](spark, str(tmp_path)).collect())) == [r for r in got if r[0] % 50 == 0]
