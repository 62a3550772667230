"""Graph queries on small graphs with known answers."""

import math
import random

import pytest

from lodestitch.functions import scalars as X
from lodestitch.operators import evidence as E
from lodestitch.operators import graph_build as G
from lodestitch.operators import graph_query as Q
from lodestitch.operators import modules as M

EDGES = [
    ("a", "b", "call", "certain"), ("a", "c", "call", "likely"), ("b", "d", "call", "certain"), ("c", "d", "call", "certain"),
    ("d", "e", "import", "certain"), ("a", "a", "call", "certain"), ("a", "f", "call", "possible"), ("x", "y", "call", "certain"),
]


def df(spark, edges=EDGES):
    return spark.createDataFrame(edges, "src_key string, dst_key string, kind string, confidence string")


def test_worked_example(spark):
    # root of degree 3, a certain call to a node of degree 1: 1 / log2(5) * 1.0 * 1 / log2(3)
    edges = df(spark, [("r", "n", "call", "certain"), ("r", "p", "call", "certain"), ("q", "r", "call", "certain")])
    root = spark.createDataFrame([("r",)], "root string")
    assert {r.other: r.relevance for r in Q.one_hop(edges, Q.degrees(edges), root).collect()} == {"n": 0.271727, "p": 0.271727, "q": 0.271727}


def test_degrees_count_a_loop_once(spark):
    got = {r.node: (r.degree, r.neighbours) for r in Q.degrees(df(spark)).collect()}
    assert got["a"] == (4, 3) and got["d"] == (3, 3) and got["y"] == (1, 1)


def test_distances(spark):
    got = {r.node: r.distance for r in Q.distances(spark, df(spark), spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "f": 1, "d": 2}


class Whole:
    """All edges in memory with true degrees, every list in full: the search without any bounded reading."""

    def __init__(self, edges, least="likely"):
        at, degree = {}, {}
        for e in edges:
            for n in {e[0], e[1]}:
                degree[n] = degree.get(n, 0) + 1
        self.degree = degree
        weight = {k: w for w, kinds in X.RELATION_WEIGHT.items() for k in kinds.split()}
        for e in edges:
            if X.CONFIDENCE_RANK[e[3]] < X.CONFIDENCE_RANK[least]:
                continue
            for a, b in {(e[0], e[1]), (e[1], e[0])}:
                at.setdefault(a, []).append((b, e, (X.CONFIDENCE_WEIGHT[e[3]], weight.get(e[2], 0.5), self.damping(b), 1.0)))
        self.at = at

    def damping(self, n):
        return 1 / math.log2(self.degree.get(n, 0) + 2)

    def best(self, asked, most):
        return {a: self.at.get(a[0], []) for a in asked}

    def among(self, nodes):
        return {}


def around(edges, anchor, least="likely", **limits):
    whole = Whole(edges, least)
    return Q.neighborhood(whole, anchor, whole.damping(anchor), **limits)


def test_neighborhood_limits():
    found, edges = around(EDGES, "a", depth=3)
    assert [n for n, _, _ in found][0] == "a" and {n for n, _, _ in found} == {"a", "b", "c", "d", "e"}
    found, edges = around(EDGES, "a", depth=3, node_limit=3)
    # edges between known nodes still enter when no new node may
    assert {n for n, _, _ in found} == {"a", "b", "c"} and len(edges) == 3
    found, edges = around(EDGES, "a", depth=3, edge_limit=1)
    assert len(edges) == 1
    assert around([], "a")[0] == [("a", 1.0, 0)]
    assert around(list(reversed(EDGES)), "a", depth=3) == around(EDGES, "a", depth=3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounded_reading_gives_the_whole_search(spark, seed):
    rnd = random.Random(seed)
    kinds, confidences = ["call", "import", "member_call", "emits"], ["certain", "likely", "possible"]
    node = lambda: f"n{int(rnd.random() ** 2 * 60)}"
    edges = list({(node(), node(), rnd.choice(kinds), rnd.choice(confidences)) for _ in range(400)})
    ends = Q.ends_table(df(spark, edges), Q.degrees(df(spark, edges)))
    for depth, nodes, limit, least in ((1, 5, 8, "likely"), (2, 10, 30, "possible"), (3, 25, 60, "possible")):
        whole = Whole(edges, least)
        reader = Q.EdgeReader(spark, ends, least)
        got = Q.neighborhood(reader, "n0", whole.damping("n0"), depth, nodes, limit)
        assert got == Q.neighborhood(whole, "n0", whole.damping("n0"), depth, nodes, limit)
        assert reader.jobs <= 3 * depth + 3


def test_a_hub_beyond_all_limits(spark):
    # an anchor with two neighbours, one of which has 20 000 further edges, the better ones last by name
    edges = [("a", "hub", "call", "certain"), ("a", "z", "call", "certain")] + [("hub", f"leaf{k:05d}", "call", "possible") for k in range(20_000)]
    edges += [("hub", "zz1", "call", "certain"), ("hub", "zz2", "call", "certain")]
    degree = Q.degrees(df(spark, edges))
    reader = Q.EdgeReader(spark, Q.ends_table(df(spark, edges), degree), "possible")
    found, scored = Q.neighborhood(reader, "a", 1 / math.log2(4), 2, 6, 10)
    assert [n for n, _, _ in found][:5] == ["a", "z", "hub", "zz1", "zz2"]
    assert dict((n, s) for n, s, _ in found)["hub"] == round(0.5 / math.log2(20_005) + 1e-12, 6)


def test_paths_and_widest():
    scored = [(e, {"certain": 0.9, "likely": 0.5, "possible": 0.1}[e[3]]) for e in EDGES]
    paths = Q.ranked_paths(scored, "a", "d")
    assert [(s, p) for s, p in paths] == [(0.9, ["a", "b", "d"]), (0.5, ["a", "c", "d"])]
    wide = Q.widest_paths(scored, ["a"])
    assert wide["d"] == (0.9, "b") and wide["c"] == (0.9, "d") and "x" not in wide


def test_export_chains(spark):
    rows = [
        (1, "f", None, 2, "g"), (2, "g", "gImpl", None, None), (3, "*", None, 4, "*"), (3, "*", None, 2, "*"), (4, "g", "other", None, None), (3, "g", None, 2, "g"),
        (5, "*", None, 6, "*"), (6, "*", None, 5, "*"), (5, "loop", None, 6, "loop"), (7, "h", None, 3, "q"), (4, "q", "qImpl", None, None),
    ]
    e = spark.createDataFrame(rows, "file_id long, export_name string, local_name string, from_file long, from_name string")
    got = {(r.file_id, r.export_name): (r.def_file, r.def_name, r.hops) for r in M.export_chains(spark, e).collect()}
    assert got == {(1, "f"): (2, "gImpl", 1), (2, "g"): (2, "gImpl", 0), (3, "g"): (2, "gImpl", 1), (4, "g"): (4, "other", 0), (7, "h"): (4, "qImpl", 2), (4, "q"): (4, "qImpl", 0)}


def test_long_chain_and_namespace(spark):
    rows = [(k, "f", None, k + 1, "f") for k in range(30)] + [(30, "f", "impl", None, None), (31, "ns", None, 30, "*"), (32, "*", None, 33, "*"), (33, "default", "d", None, None)]
    e = spark.createDataFrame(rows, "file_id long, export_name string, local_name string, from_file long, from_name string")
    wanted = spark.createDataFrame([(0, "f"), (31, "ns"), (32, "default"), (99, "f")], "file_id long, export_name string")
    got = {(r.file_id, r.export_name): (r.def_file, r.def_name, r.hops) for r in M.export_chains(spark, e, wanted).collect()}
    assert got == {(0, "f"): (30, "impl", 30), (31, "ns"): (30, "*", 1)}  # a star passes on no default
    assert M.export_chains(spark, e.limit(0)).count() == 0


SOURCES = {
    "src/app.ts": "import { load as read, type T } from './lib/index'\nimport whole, { part } from '../pkg/util.js'\nimport type { Only } from './types'\nconst x = require('left-pad')\nconst { a: b } = require('./lib')\nawait import('./gone')",
    "src/lib/index.ts": "export * from './impl'\nexport { other as renamed } from './impl'\nexport * as space from './impl'\nexport default function main() {}",
    "src/lib/impl.ts": "export const load = 1\nexport class Other {}\nconst other = 2\nexport { other }\nexport default class {}",
    "src/types.d.ts": "export interface Only {}", "pkg/util.ts": "export function part() {}\nexport * from './loop'", "pkg/loop.mts": "export * from './util'",
}


def test_modules(spark):
    files = spark.createDataFrame([(k, p, "r") for k, p in enumerate(SOURCES)] + [(90, "src/lib/impl.ts", "other"), (91, "src/gone.ts", "other")], "id long, path string, repo string")
    sources = spark.createDataFrame([(k, t) for k, t in enumerate(SOURCES.values())] + [(90, None), (95, "import x from './y'")], "file_id long, content string")
    imports = E.imports(sources)
    assert {(r.local_name, r.imported_name, r.request, r.type_only) for r in imports.filter("file_id = 0").collect()} == {
        ("read", "load", "./lib/index", False), ("T", "T", "./lib/index", False), ("whole", "default", "../pkg/util.js", False), ("part", "part", "../pkg/util.js", False),
        ("Only", "Only", "./types", True), ("x", "*", "left-pad", False), ("b", "a", "./lib", False), (None, "*", "./gone", False), (None, "*", "left-pad", False), (None, "*", "./lib", False)}
    exports = E.exports(sources)
    assert {(r.export_name, r.local_name, r.from_request, r.from_name) for r in exports.filter("file_id = 1").collect()} == {
        ("*", None, "./impl", "*"), ("renamed", None, "./impl", "other"), ("space", None, "./impl", "*"), ("default", "main", None, None)}
    assert ("default", "default") in {(r.export_name, r.local_name) for r in exports.filter("file_id = 2").collect()}
    requests = imports.select("file_id", "request", "type_only").unionByName(exports.filter("from_request IS NOT NULL").selectExpr("file_id", "from_request AS request", "false AS type_only"))
    edges = M.module_edges(files, requests)
    got = {(r.from_file, r.request): (r.to_file, r.package, r.resolution, r.type_only) for r in edges.collect()}
    assert got[0, "./lib/index"] == got[0, "./lib"] == (1, None, "resolver", False) and got[0, "../pkg/util.js"] == (4, None, "resolver", False)
    assert got[0, "./types"] == (None, None, "unresolved", True) and got[0, "./gone"] == (None, None, "unresolved", False)
    assert got[0, "left-pad"] == (None, "left-pad", None, False) and (95, "./y") not in got
    chains = {(r.file_id, r.export_name): (r.def_file, r.def_name) for r in M.export_chains(
        spark, M.linked_exports(exports, edges), spark.createDataFrame([(1, "load"), (1, "renamed"), (1, "space"), (1, "default"), (4, "part"), (5, "part"), (5, "nothing")], "file_id long, export_name string")).collect()}
    assert chains == {(1, "load"): (2, "load"), (1, "renamed"): (2, "other"), (1, "space"): (2, "*"), (1, "default"): (1, "main"), (4, "part"): (4, "part"), (5, "part"): (4, "part")}
    workspace = spark.createDataFrame([("@w/util", "pkg")], "name string, root string")
    asked = spark.createDataFrame([(0, "@w/util/util", False), (0, "@w/none", False)], "file_id long, request string, type_only boolean")
    assert {r.request: (r.to_file, r.package, r.resolution) for r in M.module_edges(files, asked, workspace).collect()} == {"@w/util/util": (4, None, "workspace"), "@w/none": (None, "@w/none", None)}


def test_ambiguous_calls_keep_every_candidate(spark):
    names = [(0, "main", "sym:main")] + [(k, "load", f"sym:load{k}") for k in range(1, 7)] + [(7, "few", "sym:few7"), (8, "few", "sym:few8"), (9, "far", "sym:far")]
    symbols = spark.createDataFrame([(k, k, f"f{k}.js", n, key) for k, n, key in names], "symbol_id long, file_id long, path string, name string, node_key string")
    refs = spark.createDataFrame([(0, 0, "call", "load"), (0, 0, "render", "few"), (0, 0, "call", "alias"), (0, 0, "call", "pkg")], "chunk_id long, file_id long, kind string, target_name string")
    imports = spark.createDataFrame([(0, "alias", None), (0, "pkg", "left-pad")], "file_id long, local_name string, package string")
    chains = spark.createDataFrame([(0, "alias", 9, "far", "certain")], "file_id long, local_name string, def_file long, def_name string, confidence string")
    edges = G.reference_edges(symbols, refs, imports, chains)
    assert {tuple(r) for r in edges.collect()} == {
        ("sym:main", "name:unknown:load", "call", "possible"), *[("name:unknown:load", f"sym:load{k}", "name_candidate", "possible") for k in range(1, 7)],
        ("sym:main", "sym:few7", "render", "possible"), ("sym:main", "sym:few8", "render", "possible"), ("sym:main", "sym:far", "call", "certain"),
        ("sym:main", "pkg:left-pad", "call", "likely")}
    assert {r.dst_key for r in G.callers(edges, symbols).collect()} == {"sym:far", *[f"sym:load{k}" for k in range(1, 7)]}


def test_events(spark):
    files = spark.createDataFrame([(1, "a.js"), (2, "b.js")], "id long, path string")
    chunks = spark.createDataFrame([(10, 1, "bus.emit('saved', 1); bus.on(\"gone\", f)"), (20, 2, "bus.once('saved', g); x.emit(name)")], "id long, file_id long, content string")
    got = {tuple(r) for r in G.event_edges(files, E.event_sites(chunks)).collect()}
    assert got == {
        ("file:a.js", "event-site:a.js:1", "contains_event", "certain"), ("file:a.js", "event-site:a.js:2", "contains_event", "certain"),
        ("file:b.js", "event-site:b.js:1", "contains_event", "certain"), ("event:unknown:gone", "event-site:a.js:1", "listens", "possible"),
        ("event-site:a.js:2", "event:unknown:saved", "emits", "possible"), ("event:unknown:saved", "event-site:b.js:1", "listens", "possible")}


def test_anchors(spark):
    symbols = spark.createDataFrame([("sym:a/x.ts#::f@1", "a/x.ts", "f"), ("sym:b/x.ts#::f@1", "b/x.ts", "f"), ("sym:b/x.ts#::g@1", "b/x.ts", "g")], "node_key string, path string, name string")
    files = spark.createDataFrame([(1, "a/x.ts"), (2, "b/x.ts"), (3, "b/g")], "id long, path string")
    wanted = spark.createDataFrame([("f",), ("g",), ("x.ts",), ("a/x.ts",), ("b/x.ts:f",), ("file:b/x.ts",), ("sym:a/x.ts#::f@1",), ("none",), (None,)], "anchor string")
    got = {r.anchor: (r.tier, r.n_candidates, r.node_key) for r in Q.resolved_anchors(wanted, symbols, files).collect()}
    assert got == {
        "f": (5, 2, None), "g": (3, 1, "file:b/g"), "x.ts": (3, 2, None), "a/x.ts": (3, 1, "file:a/x.ts"), "b/x.ts:f": (4, 1, "sym:b/x.ts#::f@1"),
        "file:b/x.ts": (2, 1, "file:b/x.ts"), "sym:a/x.ts#::f@1": (1, 1, "sym:a/x.ts#::f@1"), "none": (None, 0, None)}


ENTITIES = """
const a = process.env.PORT, b = process.env['DB_URL']; config.get('k1'); appConfigService.getOrThrow("k2");
await fetch('https://api.example.org/x'); axios.post("http://h.example/x"); userRouter.get('/users', f); @Post('items') create() {}
apolloClient.query({ findUser }); @Query(() => User) async user(id) {} ; if (flags.isEnabled('beta')) {}
userRepository.findOne(1); orderModel.save(o); ds.getRepository(Order); mailQueue.add('send', 1); new Worker("resize", f); @Cron('daily') run() {}
defineLogicFunction({ universalIdentifier: 'lf-1', handler }); const t = { targetLogicFunctionUniversalIdentifier: 'lf-1' };
x = { databaseEventTriggerSettings: { eventName: 'person.created' } }; client.mutation({ createPerson: 1 });
providers = [{ provide: Clock, useClass: SystemClock }]; class S { constructor(@Inject(Clock) c: Clock): Result { const q: Query = 1 } }
interface Shape {} type Alias = 1; enum Kind {} ; const schema = z.object({}); class CreateDto {}
"""


def test_entity_sites(spark):
    from lodestitch.operators import entities as N

    rows = N.sites(spark.createDataFrame([(1, ENTITIES), (2, None), (3, "")], "file_id long, content string")).collect()
    got = {(r.role, r.name) for r in rows}
    assert got >= {
        ("environment_read", "PORT"), ("environment_read", "DB_URL"), ("config_read", "k1"), ("config_read", "k2"), ("external_host_call", "api.example.org"),
        ("external_host_call", "h.example"), ("route_handler", "/users"), ("route_handler", "items"), ("graphql_operation", "findUser"), ("graphql_handler", "user"),
        ("feature_flag_check", "beta"), ("database_read", "userRepository"), ("database_write", "orderModel"), ("database_acquire", "Order"), ("job_producer", "send"),
        ("job_handler", "resize"), ("job_handler", "daily"), ("registered_handler", "lf-1"), ("dispatch_site", "lf-1"), ("lifecycle_listener", "person.created"),
        ("lifecycle_producer", "createPerson"), ("provider", "Clock"), ("injection_site", "Clock"), ("contract_declaration", "Shape"), ("contract_declaration", "Alias"),
        ("contract_declaration", "Kind"), ("contract_declaration", "schema"), ("contract_declaration", "CreateDto"), ("parameter_contract", "Clock") , ("return_contract", "Result"),
        ("contract_reference", "Query"), ("decorator_use", "Inject")}
    assert {r.file_id for r in rows} == {1}
