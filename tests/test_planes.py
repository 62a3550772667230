"""Intervals, memory, policy, metrics and refresh on small relations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import chunker, udfs
from lodestitch.functions import scalars as X
from lodestitch.operators import intervals as I
from lodestitch.operators import memory as M
from lodestitch.operators import metrics as A
from lodestitch.operators import policy as P
from lodestitch.operators import retrieval as R
from lodestitch.operators import text_index as T
from lodestitch.sources import files as S
from lodestitch.sources import tables as B
from lodestitch.streaming import watch as L


def test_innermost_breaks_ties_by_start(spark):
    points = spark.createDataFrame([(1, 9, 15), (2, 9, 99), (3, 8, 15)], "id long, file long, at long")
    spans = spark.createDataFrame([(10, 9, 0, 100), (11, 9, 10, 20), (12, 9, 12, 22), (13, 9, 15, 15)], "sid long, file long, s long, e long")
    got = {r.id: (r.container, r.width) for r in I.innermost(points, spans, "file", "at", "s", "e", "id", "sid").collect()}
    assert got == {1: (11, 10), 2: (10, 100)}
    assert {r.id for r in I.innermost(points, spans, "file", "at", "s", "e", "id", "sid", True).filter("container = 13").collect()} == {1}


def test_overlaps_against_all_pairs(spark):
    import random

    rnd = random.Random(4)
    rows = [(k, k % 3, a, a + rnd.choice([0, 5, 300, 9000])) for k in range(150) for a in [rnd.randrange(20_000)]] + [(900, 0, None, 5), (901, 0, 7, None), (902, 1, 50, 40)]
    df = spark.createDataFrame(rows, "id long, f long, s long, e long")
    full = [r for r in rows if r[2] is not None and r[3] is not None]
    for inclusive in (False, True):
        meets = lambda x, y: x[2] <= y[3] and x[3] >= y[2] if inclusive else x[2] < y[3] and x[3] > y[2]
        got = [(r.left_key, r.right_key) for r in I.overlapping(df, df, "f", "s", "e", "id", "id", inclusive).collect()]
        want = {(x[0], y[0]) for x in full for y in full if x[1] == y[1] and meets(x, y)}
        assert len(got) == len(set(got)) and {p for p in got if p[0] != 902 and p[1] != 902} == {p for p in want if p[0] != 902 and p[1] != 902}


def test_longest_prefix(spark):
    paths = spark.createDataFrame([(1, "a/b/c/d.ts"), (2, "a/x.ts"), (3, "z.ts"), (4, "ab/c.ts")], "id long, path string")
    roots = spark.createDataFrame([("a", 10), ("a/b", 11), ("a/b/c", 12)], "root string, rid long")
    assert {r.id: r.owner for r in I.longest_prefix(paths, roots, "path", "id", "root", "rid").collect()} == {1: 12, 2: 10}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "bird fish"), (4, None), (5, "")], "id long, text string")
    got = {r.id: r.score for r in T.bm25(docs, "id", ["cat"], {"text": 1.0}).collect()}
    import math

    idf = math.log((5 - 1 + 0.5) / 1.5)
    assert got == {1: pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.2)), abs=1e-6)}
    assert T.bm25(docs.limit(0), "id", ["cat"], {"text": 1.0}).count() == 0


def test_fusion_and_keep_first(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    b = spark.createDataFrame([(3, 1), (1, 2)], "id long, rank long")
    assert [r.id for r in R.reciprocal_rank_fusion([a, b], "id", 10).orderBy("rank").collect()] == [1, 3, 2]
    assert {r.id: (r.list_no, r.rank) for r in R.keep_first([a, b], "id").collect()} == {1: (0, 1), 2: (0, 2), 3: (1, 1)}


def test_freshness_goes_up(spark):
    own = spark.createDataFrame([(k, "fresh") for k in range(12)] + [(20, "stale"), (21, "degraded")], "id long, freshness string")
    links = spark.createDataFrame([(k, k + 1) for k in range(11)] + [(11, 20), (20, 21), (0, 0)], "parent long, child long")
    got = {r.id: r.freshness for r in M.hierarchical_freshness(spark, own, links).collect()}
    assert got[20] == "stale" and got[21] == "degraded" and got[11] == "degraded" and got[4] == "degraded" and got[2] == "fresh"


def test_evidence_paths_skip_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "parent long, child long")
    got = sorted(r.path for r in M.evidence_paths(spark, links, spark.createDataFrame([(1,)], "id long")).collect())
    assert got == ["1>2", "1>2>3", "1>4"]


def test_policy(spark):
    rows = [(1, "a", "test", "possible", True), (2, "a", "docs", "certain", True), (3, "a/b", "test", "possible", True), (4, "c", "x", "certain", False), (5, "c", "y", "possible", True)]
    df = spark.createDataFrame(rows, "id long, subject string, role string, confidence string, valid boolean")
    assert {(r.subject, r.id) for r in P.reconciled(df).collect()} == {("a", 2), ("c", 5)}


def test_metrics(spark):
    df = spark.createDataFrame([("g", float(k)) for k in range(19)] + [("h", float(k)) for k in range(20)] + [("n", None)], "g string, v double")
    got = {r.g: (r.median, r.lower_index, r.nearest_rank) for r in A.percentiles(df, "g", "v", 0.95).collect()}
    assert got == {"g": (9.0, 17.0, None), "h": (9.5, 18.0, 18.0)}
    sets = spark.createDataFrame([([], []), ([], [1]), ([1, 2], [2]), ([1], [])], "p array<long>, g array<long>")
    assert [(r[0], r[1]) for r in sets.select(A.set_precision(F.col("p"), F.col("g")), A.set_recall(F.col("p"), F.col("g"))).collect()] == [(1.0, 1.0), (0.0, 0.0), (0.5, 1.0), (0.0, 1.0)]
    low, high = A.bootstrap([[1.0, 2.0], [3.0], [2.0]], 500)
    assert 1.0 <= low <= 2.0 <= high <= 3.0


def test_generations_batch_equals_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("r", t + timedelta(seconds=s), f"p{s}.ts") for s in (0, 1, 2, 10, 11, 30)] + [("q", t, "a/package.json"), ("z", t + timedelta(hours=1), "x.ts")]
    df = spark.createDataFrame(rows, "root string, ts timestamp, path string")
    gens = L.generations(df, "root", "ts", 5)
    assert sorted((r.root, r.n_signals, r.full_refresh) for r in L.merged(gens, "root", "ts", "path", L.scope_rank(L.classified(F.col("path")))).collect()) == [
        ("q", 1, True), ("r", 1, False), ("r", 2, False), ("r", 3, False), ("z", 1, False)]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = L.stream_sessions(spark, stream, "root", "ts", "5 seconds", "1 second")
    assert sorted((r.root, r.n_signals) for r in out.collect()) == [("q", 1), ("r", 1), ("r", 2), ("r", 3)]


def test_refresh_equals_rebuild(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, digest string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "id long, digest string")
    plan = L.refresh_plan(old, new, "id", "digest")
    assert {r.id: r.action for r in plan.collect()} == {1: "removed", 2: "kept", 3: "changed", 4: "added"}
    assert sorted(map(tuple, L.refreshed(old, plan, "id", new).collect())) == sorted(map(tuple, new.collect()))


def test_walk_and_roles(spark, tmp_path):
    for p, text in {"a.ts": b"x", "src/generated/b.js": b"y", "node_modules/c.js": b"z", ".hid/d.ts": b"q", "e.md": b"r", "f.ts": b"\xff\xfe"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(text)
    files, rejected = S.walk(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"a.ts", "src/generated/b.js"} and [r.path for r in rejected.collect()] == ["f.ts"]
    roles = {r.path: r.role for r in files.select("path", S.file_role(F.col("path"), F.col("content")).alias("role")).collect()}
    assert roles == {"a.ts": "production", "src/generated/b.js": "generated"}


def test_role_markers(spark):
    cases = {
        "src/doc/a.ts": "production", "Docs/a.ts": "documentation", "a/testing/x.ts": "test", "a/x.e2e.ts": "test", "stubs/x.ts": "fixture", "x.mock.ts": "fixture",
        "pb_generated.js": "generated", "examples/a.ts": "production", "test/fixtures/a.ts": "fixture", "latest/a.ts": "production", "a\\tests\\b.ts": "test",
    }
    df = spark.createDataFrame([(p, "") for p in cases] + [("h.ts", "// AUTO-GENERATED by x"), ("n.ts", "// please do not edit"), ("z.ts", None)], "path string, content string")
    got = {r.path: r.role for r in df.select("path", S.file_role(F.col("path"), F.col("content")).alias("role")).collect()}
    assert got == {**cases, "h.ts": "generated", "n.ts": "production", "z.ts": "production"}


def test_lines_of_offsets(spark):
    spans = spark.createDataFrame([(1, 7, 0), (2, 7, 3), (3, 7, 4), (4, 7, 99), (5, 7, None), (6, 8, 0), (7, 9, 0)], "id long, file long, at long")
    texts = spark.createDataFrame([(7, "ab\r\nä\n\nx"), (8, ""), (9, None)], "file long, content string")
    assert {r.id: r.line for r in S.lines_of(spans, texts, "id", "file", "at").collect()} == {1: 1, 2: 1, 3: 2, 4: 4, 6: 1}


def test_leading_comments_and_workspaces(spark):
    text = "// one\nf();\n\n/* two\n * lines */\ng();\n// far\n\nh();\nlet x; // tail\n  i();"
    at = {name: text.index(f"{name}()") for name in "fghi"}
    spans = spark.createDataFrame([(n, 1, a) for n, a in at.items()] + [("z", 2, 0), ("n", 1, None)], "k string, file long, at long")
    got = {r.k: r.start for r in S.leading_comment_starts(spans, spark.createDataFrame([(1, text), (2, "")], "file long, content string"), "k", "file", "at").collect()}
    assert got == {"f": 0, "g": text.index("/* two"), "h": at["h"], "i": at["i"], "z": 0}
    rows = [("packages/a/package.json", '{"name": "@w/a", "main": "lib/a.js"}'), ("packages/b/package.json", '{"name": "@w/b"}'), ("packages/c/package.json", "{"), ("packages/x/y/package.json", '{"name": "@w/y"}'), ("package.json", '{"name": "root"}')]
    found = S.workspaces(spark.createDataFrame(rows, "path string, text string"), ["packages/*"])
    assert {tuple(r) for r in found.collect()} == {("packages/a", "@w/a", "lib/a.js"), ("packages/b", "@w/b", "src/index.ts")}


def test_a_line_above_the_maximum_is_cut():
    source = "x('" + "ä" * 30_000 + "');\nshort();\n"
    got = chunker.chunks(source)
    assert all(chunker.tokens(x[4]) <= chunker.MOST for x in got)
    assert "".join(x[4] for x in got if x[2] == 1) == source.split("\n")[0]


def test_chunker_keeps_every_line_of_code():
    source = "import a from 'a';\nimport b from 'b';\n\n// about f\nfunction f() {\n  return 1;\n}\n\na();\nb();\n" + "const big = [\n" + "  'xxxxxxxxxxxxxxxxxxxxxxxx',\n" * 900 + "];\n"
    got = chunker.chunks(source)
    assert [(k, n) for k, n, *_ in got][:3] == [("imports", None), ("function", "f"), ("module", None)]
    assert got[1][4].startswith("// about f") and got[3][1] == "big#part1"
    assert all(chunker.tokens(x[4]) <= chunker.MOST for x in got)
    kept = {n for _, _, a, b, _ in got for n in range(a, b + 1)}
    assert all(n in kept or not line.strip() for n, line in enumerate(source.split("\n"), 1))
    assert chunker.chunks("") == [] and chunker.chunks("\n\n") == []


def test_scalars(spark):
    df = spark.createDataFrame([("https://u:p@Ex.org:8/x", "äöü€", "@a/b/c"), ("no", "abc", "./x"), (None, None, None)], "u string, t string, r string")
    rows = df.select(X.url_host(F.col("u")), X.truncated_utf8(F.col("t"), 5), X.package_name(F.col("r")), X.encoded_key(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("ex.org", "äö", "@a/b", "%C3%A4%C3%B6%C3%BC%E2%82%AC"), (None, "abc", None, "abc"), (None, None, None, None)]
    assert udfs.mentions("a // b\n'b' `b`", "b") is False and udfs.mentions("x.b()", "b") and not udfs.mentions("$b", "b")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    root = str(tmp_path / "pub")
    B.publish(spark, {"t": df.limit(0)}, root)
    B.publish(spark, {"t": df}, root)
    assert spark.read.parquet(B.published(spark, root) + "/t.parquet").count() == 2
    up = B.upserted(df, spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id long, v string"), ["id"], "v")
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert [len(b) for b in B.batched(list(range(300)), 128, 10_000)] == [128, 128, 44] and max(map(len, B.batched(["x" * 90] * 8, 8, 400))) <= 4
    taken = B.greedy_budget(spark.createDataFrame([("g", 1, 50, False), ("g", 2, 60, False), ("g", 3, 40, False), ("g", 4, 70, True)], "g string, id long, n long, must boolean"), "g", ["id"], "n", 120, "must")
    assert {r.id for r in taken.filter("taken").collect()} == {4, 1}
    with pytest.raises(Exception):
        B.embedded(df, "id", "v", lambda t: [[0.0, 1.0]] * len(t), 1).collect()


def test_bootstrap_intervals_take_ten_thousand_resamples(spark):
    clusters = [[k * k * 0.37 + j for j in range(1 + k % 3)] for k in range(12)]
    df = spark.createDataFrame([("g", k, v) for k, vs in enumerate(clusters) for v in vs], "g string, k long, v double")
    got = A.bootstrap_intervals(df, "g", "k", "v").first()
    assert (got.low, got.high) == tuple(round(x, 6) for x in A.bootstrap(clusters))
    assert (got.low, got.high) != tuple(round(x, 6) for x in A.bootstrap(clusters, 1000))
