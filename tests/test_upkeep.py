"""Batches, carried answers, reranking, shedding, phases, keys and guards on small relations."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestitch.operators import memory as M
from lodestitch.operators import upkeep as U
from lodestitch.sources import tables as T


def test_carried_needs_every_owner(spark):
    files = spark.createDataFrame([(1, "r", 5), (2, "r", None), (3, None, None)], "id long, repo string, package_instance_id long")
    chunks = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 9)], "chunk_id long, file_id long")
    owned = U.owners(chunks, files)
    assert {tuple(r) for r in owned.collect()} == {(10, "repo:r"), (10, "package:5"), (20, "repo:r")}
    fresh = spark.createDataFrame([("repo:r",), ("repo:r",)], "project string")
    assert {r.chunk_id: r.carried for r in U.carried(owned, fresh).collect()} == {10: False, 20: True}
    assert U.carried(owned.limit(0), fresh).count() == 0


def test_checker_facts(spark):
    facts = spark.createDataFrame([("o", "a", "p", False), ("o", "a", "q", True), ("o", "b", "p", False), ("x", "a", "q", False)], "occurrence string, target string, project string, possible boolean")
    failed = spark.createDataFrame([("q",)], "project string")
    assert {tuple(r) for r in U.checker_facts(facts, failed).collect()} == {("o", "a", "possible", 2), ("o", "b", "certain", 2), ("x", "a", "possible", 1)}


def test_rerank_keeps_every_id_and_the_tail(spark):
    ranked = spark.createDataFrame([(g, k, k) for g in (1, 2, 3) for k in range(1, 5)], "g long, k long, rank long")
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.5), (1, 4, 9.0), (2, 1, 0.1), (2, 2, None), (2, 3, 0.4), (3, 1, 0.1), (3, 2, 0.5), (3, 2, 0.6), (3, 3, 0.7)], "g long, k long, score double")
    got = {}
    for r in U.reranked(ranked, scores, "g", "k", 3).orderBy("g", "rank").collect():
        got.setdefault((r.g, r.degraded), []).append(r.k)
    assert got == {(1, False): [2, 3, 1, 4], (2, True): [1, 2, 3, 4], (3, True): [1, 2, 3, 4]}


def test_shedding_and_overfetch(spark):
    sections = spark.createDataFrame([("g", 1, 40), ("g", 2, 30), ("g", 2, 20), ("g", 3, 20)], "g string, tier long, n long")
    assert {r.tier: r.kept for r in U.shed(sections, "g", "tier", "n", 90).collect()} == {1: True, 2: True, 3: False}
    rows = spark.createDataFrame([("g", k, k % 60 == 0) for k in range(1, 400)], "g string, rank long, good boolean")
    got = U.overfetched(rows, "g", F.col("good"), 5).collect()
    assert [r.rank for r in got] == [60, 120, 180] and all(r.exhausted for r in got)  # the pool ends at 200


def test_generations_phases_and_retries(spark):
    t = datetime(2024, 1, 1)
    rows = [("r", 1, t, t + timedelta(seconds=5)), ("r", 2, t + timedelta(seconds=20), t + timedelta(seconds=21)), ("q", 1, t, t)]
    g = U.superseded(spark.createDataFrame(rows, "root string, generation long, first_ts timestamp, last_ts timestamp"), "root", 30)
    assert {(r.root, r.generation): r.superseded for r in g.collect()} == {("r", 1): True, ("r", 2): False, ("q", 1): False}
    assert sorted((r.root, r.generation, r.phase) for r in U.phases(g).collect() if r.root == "r")[:2] == [("r", 1, "refresh"), ("r", 2, "embed")]
    assert [r[0] for r in spark.range(9).select(U.retry_delay(F.col("id"))).collect()] == [0.5, 1, 2, 4, 8, 16, 30, 30, 30]
    tries = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, None), (2, 2, False), (2, 3, False), (2, 4, True)], "id long, n long, ok boolean")
    assert {tuple(r) for r in U.first_answers(tries, "id", [F.col("n")], F.col("ok")).collect()} == {(1, True, 2), (2, False, 3)}


def test_owners_fall_back(spark):
    rows = spark.createDataFrame([(1, "a", "auxiliary"), (2, "a", None), (3, "b", "auxiliary"), (4, "c", "runtime")], "id long, g string, purpose string")
    got = {r.id: (r.selected, r.fallback) for r in U.selected_owners(rows, "g", F.col("purpose")).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, True), 4: (True, False)}


def test_keys_strings_and_graph(spark):
    keys = spark.createDataFrame([("sym:a/b.ts#A.m::x@2",), ("file:a:b.ts",), ("pkg:@s/p",), ("sym:broken",)], "k string")
    got = [tuple(r.p) for r in keys.select(U.parsed_key(F.col("k")).alias("p")).collect()]
    assert got == [("sym", "a/b.ts", "A.m", "x", 2), ("file", "a:b.ts", None, None, None), ("pkg", "@s/p", None, None, None), ("sym", "", "", "", None)]
    texts = spark.createDataFrame([("'a'",), ('"b"',), ("`c`",), ("`x${'y'}z`",), ("`x${y}`",), ("name",), ("'a\\n'",), (None,)], "x string")
    assert [r[0] for r in texts.select(U.static_string(F.col("x"))).collect()] == ["a", "b", "c", "xyz", None, None, None, None]
    edges = spark.createDataFrame([("n2", "n1", "call", "certain"), ("n1", "n3", "call", "likely")], "src_key string, dst_key string, kind string, confidence string")
    assert {r.text for r in U.compact_graph(edges).collect()} == {'{"a":1,"b":0,"kind":"call"}', '{"a":0,"b":2,"kind":"call","confidence":"likely"}'}


def test_claims_and_support_states(spark):
    t = datetime(2024, 5, 1)
    runs = spark.createDataFrame([("k", 1, t), ("k", 2, t + timedelta(days=1)), ("o", 3, t - timedelta(days=200))], "kind string, id long, exported_at timestamp")
    now = spark.createDataFrame([(t,)], "now timestamp")
    assert {r.id: r.claim for r in M.claims(runs, ["kind"], now, 90).collect()} == {1: "superseded", 2: "live", 3: "orphan"}
    supports = spark.createDataFrame([(1, 1, "h", "c", "h", "c"), (1, 2, "h", "c", "g", "c"), (1, 3, "h", "c", "h", None), (1, 4, None, None, None, None)],
                                     "artifact_id long, chunk_id long, stored_hash string, stored_context string, now_hash string, now_context string")
    assert {r.chunk_id: r.state for r in M.stored_freshness(supports).collect()} == {1: "fresh", 2: "source-stale", 3: "context-stale", 4: "fresh"}


def test_scan_bounds(spark):
    files = spark.createDataFrame([("g", k, n, must) for k, n, must in ((1, 10, False), (2, 900, False), (3, 10, False), (4, 10, False), (5, 5000, True), (6, None, False))], "g string, id long, n long, must boolean")
    taken = T.greedy_budget(files, "g", ["id"], "n", 6000, "must", 3, 100)
    assert {r.id for r in taken.filter("taken").collect()} == {5, 1, 3}  # a forced file is no matter of the bounds
