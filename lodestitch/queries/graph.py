"""Evidence, graph projection and graph queries over the indexed chunks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import evidence as E
from ..operators import graph_build as G
from ..operators import graph_query as Q
from ..operators import intervals as I
from ..operators import modules as M
from ..session import published, table
from .registry import Registry

REG = Registry()
c = F.col


def put(name, sql, f):
    REG.add(name, sql)(f)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


KIND = """CASE WHEN regexp_replace(lower(kind), '[^a-z]', '', 'g') IN ('import', 'imports') THEN 'imports'
 WHEN starts_with(regexp_replace(lower(kind), '[^a-z]', '', 'g'), 'classheader') THEN 'class_header' ELSE regexp_replace(lower(kind), '[^a-z]', '', 'g') END"""
PACKAGE = r"CASE WHEN NOT regexp_matches(request, '^(?:\.{0,2}/|\.{1,2}$|[a-z]+:|#)') AND request <> '' THEN regexp_extract(request, '^(@[^/]+/[^/]+|[^/]+)', 1) END"
SYM = f"""sym AS (SELECT c.id AS symbol_id, c.file_id, f.path, f.role, c.name, {KIND.replace('kind', 'c.kind')} AS kind, coalesce(c.scope_chain, '') AS scope,
  c.start_byte AS decl_start, c.end_byte AS decl_end, c.start_line AS line, regexp_matches(c.content, '^\\s*export\\b') AS exported,
  row_number() OVER (PARTITION BY f.path, coalesce(c.scope_chain, ''), c.name ORDER BY c.start_byte, c.id) AS ordinal,
  'sym:' || f.path || '#' || coalesce(c.scope_chain, '') || '::' || c.name || '@' || row_number() OVER (PARTITION BY f.path, coalesce(c.scope_chain, ''), c.name ORDER BY c.start_byte, c.id) AS node_key
  FROM chunks c JOIN files f ON f.id = c.file_id WHERE c.name IS NOT NULL AND {KIND.replace('kind', 'c.kind')} IN ('function', 'class', 'method', 'component'))"""
def _found(kind: str, pattern: str) -> str:
    return f"SELECT id AS chunk_id, file_id, '{kind}' AS kind, unnest(regexp_extract_all(content, {_q(pattern)}, 1)) AS target_name FROM chunks"


REF = f"""refk AS (SELECT chunk_id, file_id, kind, target_name, count(*) AS n FROM ({_found('call', E.CALL)} UNION ALL {_found('extend', E.EXTEND)} UNION ALL {_found('render', E.RENDER)})
  WHERE kind <> 'call' OR target_name NOT IN ({', '.join(map(_q, E.NOT_CALLS))}) GROUP BY ALL),
ref AS (SELECT chunk_id, file_id, target_name, n FROM refk WHERE kind = 'call')"""
MEM = f"""mem AS (SELECT chunk_id, file_id, p[1] AS object, p[2] AS prop, count(*) AS n FROM (SELECT id AS chunk_id, file_id,
  unnest(list_zip(regexp_extract_all(content, {_q(E.MEMBER)}, 1), regexp_extract_all(content, {_q(E.MEMBER)}, 2))) AS p FROM chunks) GROUP BY ALL)"""


def _pairs_sql(pattern: str, columns: str = "file_id") -> str:
    return f"SELECT {columns}, unnest(list_zip(regexp_extract_all(content, {_q(pattern)}, 1), regexp_extract_all(content, {_q(pattern)}, 2))) AS p FROM source_files"


def _listed(pattern: str, type_only: str) -> str:
    return f"SELECT file_id, p[1] AS names, p[2] AS request, {type_only} AS type_only FROM ({_pairs_sql(pattern)})"


_ENTRY = r"string_split_regex(regexp_replace(regexp_replace(one, '^\s+|\s+$', '', 'g'), '^type\s+', ''), '\s+as\s+|\s*:\s*')"
IMP = rf"""imp AS (SELECT file_id, local_name, imported_name, request, bool_and(type_only) AS type_only, {PACKAGE} AS package FROM (
  SELECT file_id, w[-1] AS local_name, w[1] AS imported_name, request, type_only FROM (SELECT file_id, {_ENTRY} AS w, request, type_only FROM (
    SELECT file_id, unnest(string_split(regexp_replace(names, '[{{}}]', '', 'g'), ',')) AS one, request, type_only FROM (
      {_listed(E.NAMED, 'false')} UNION ALL SELECT * FROM ({_listed(E.REQUIRE, 'false')} UNION ALL {_listed(E.TYPES, 'true')}) WHERE starts_with(names, '{{')))
    WHERE regexp_replace(one, '^\s+|\s+$', '', 'g') <> '')
  UNION ALL SELECT file_id, names, 'default', request, type_only FROM ({_listed(E.WHOLE, 'false')} UNION ALL SELECT * FROM ({_listed(E.TYPES, 'true')}) WHERE NOT starts_with(names, '{{'))
  UNION ALL SELECT file_id, names, '*', request, type_only FROM ({_listed(E.STAR, 'false')} UNION ALL SELECT * FROM ({_listed(E.REQUIRE, 'false')}) WHERE NOT starts_with(names, '{{'))
  UNION ALL SELECT file_id, NULL, '*', request, type_only FROM ({_listed(E.DYNAMIC, 'false')})) GROUP BY file_id, local_name, imported_name, request)"""
EXP = rf"""exp AS (SELECT DISTINCT * FROM (
  SELECT file_id, p[2] AS export_name, p[2] AS local_name, NULL::VARCHAR AS from_request, NULL::VARCHAR AS from_name FROM ({_pairs_sql(E.EXPORT_DECLARED)})
  UNION ALL SELECT file_id, 'default', coalesce(nullif(p[2], ''), 'default'), NULL, NULL FROM ({_pairs_sql(E.EXPORT_DEFAULT)})
  UNION ALL SELECT file_id, w[-1], CASE WHEN request = '' THEN w[1] END, nullif(request, ''), CASE WHEN request <> '' THEN w[1] END FROM (
    SELECT file_id, {_ENTRY} AS w, request FROM (SELECT file_id, unnest(string_split(p[1], ',')) AS one, p[2] AS request FROM ({_pairs_sql(E.EXPORT_LIST)})) WHERE regexp_replace(one, '^\s+|\s+$', '', 'g') <> '')
  UNION ALL SELECT file_id, coalesce(nullif(p[1], ''), '*'), NULL, p[2], '*' FROM ({_pairs_sql(E.EXPORT_STAR)})))"""
_STEM, _EXT = r"regexp_replace(base, '\.[a-z]+$', '')", r"regexp_extract(base, '\.([a-z]+)$', 1)"
_CANDIDATES = "list_concat(list_concat(CASE " + " ".join(
    f"WHEN {_EXT} = '{e}' THEN [{', '.join(f'{_STEM} || {_q(chr(46) + o)}' for o in others)}]" for e, others in M.STANDS_FOR.items()
) + f" ELSE [base] END, [{', '.join(f'base || {_q(chr(46) + e)}' for e in M.EXTENSIONS)}]), [{', '.join(f'base || {_q(chr(47) + chr(105) + chr(110) + chr(100) + chr(101) + chr(120) + chr(46) + e)}' for e in M.EXTENSIONS)}])"
MOD = rf"""req AS (SELECT file_id, request, bool_and(type_only) AS type_only FROM (SELECT file_id, request, type_only FROM imp UNION ALL SELECT file_id, from_request, false FROM exp WHERE from_request IS NOT NULL) GROUP BY ALL),
based AS (SELECT r.*, coalesce(f.repo, '') AS repo, CASE WHEN regexp_matches(request, '^\.{{1,2}}(?:/|$)') THEN array_to_string(list_reduce(list_prepend(string_split(path, '/')[1:len(string_split(path, '/')) - 1],
  list_transform(string_split(request, '/'), lambda x: [x])), lambda a, b: CASE WHEN b[1] IN ('.', '') THEN a WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END), '/') END AS base FROM req r JOIN files f ON f.id = r.file_id),
cand AS (SELECT repo, base, unnest({_CANDIDATES}) AS cpath, generate_subscripts({_CANDIDATES}, 1) AS at FROM (SELECT DISTINCT repo, base FROM based WHERE base IS NOT NULL)),
hit AS (SELECT c.repo, c.base, arg_min(f.id, (c.at, f.id)) AS to_file FROM cand c JOIN files f ON f.path = c.cpath AND coalesce(f.repo, '') = c.repo GROUP BY 1, 2),
mod AS (SELECT b.file_id AS from_file, b.request, h.to_file, CASE WHEN h.to_file IS NULL AND b.base IS NULL THEN {PACKAGE.replace('request', 'b.request')} END AS package,
  CASE WHEN h.to_file IS NOT NULL THEN 'resolver' WHEN b.base IS NOT NULL OR {PACKAGE.replace('request', 'b.request')} IS NULL THEN 'unresolved' END AS resolution, b.type_only
  FROM based b LEFT JOIN hit h ON h.repo = b.repo AND h.base = b.base)"""
CHAIN = """lexp AS (SELECT e.*, m.to_file AS from_file FROM exp e LEFT JOIN mod m ON m.from_file = e.file_id AND m.request = e.from_request),
walk AS (SELECT DISTINCT file_id, export_name, file_id AS at_file, export_name AS at_name, []::VARCHAR[] AS ord, [file_id || ' ' || export_name] AS seen FROM lexp WHERE export_name <> '*'
  UNION ALL SELECT w.file_id, w.export_name, n.from_file, n.next_name, list_append(w.ord, lpad(n.from_file::VARCHAR, 20, '0')), list_append(w.seen, n.from_file || ' ' || n.next_name)
  FROM walk w, LATERAL (SELECT e.from_file, CASE WHEN e.export_name = '*' THEN w.at_name ELSE e.from_name END AS next_name FROM lexp e WHERE e.file_id = w.at_file AND e.from_file IS NOT NULL AND (
    e.export_name = w.at_name AND e.local_name IS NULL AND e.from_name <> '*'
    OR e.export_name = '*' AND w.at_name <> 'default' AND NOT EXISTS (SELECT 1 FROM lexp x WHERE x.file_id = w.at_file AND x.export_name = w.at_name))) n
  WHERE NOT list_contains(w.seen, n.from_file || ' ' || n.next_name)),
chain AS (SELECT file_id, export_name, d.def_file, d.def_name, d.hops FROM (SELECT file_id, export_name, min({'ord': ord, 'def_file': def_file, 'def_name': def_name, 'hops': hops}) AS d FROM (
  SELECT w.file_id, w.export_name, w.ord, w.at_file AS def_file, e.local_name AS def_name, len(w.ord)::BIGINT AS hops FROM walk w JOIN lexp e ON e.file_id = w.at_file AND e.export_name = w.at_name WHERE e.local_name IS NOT NULL
  UNION ALL SELECT w.file_id, w.export_name, w.ord, e.from_file, '*', len(w.ord) + 1 FROM walk w JOIN lexp e ON e.file_id = w.at_file AND e.export_name = w.at_name WHERE e.local_name IS NULL AND e.from_name = '*' AND e.from_file IS NOT NULL) GROUP BY 1, 2))"""
EVT = f"""evt AS (SELECT chunk_id, e.file_id, e.name, e.method, e.role, f.path, 'event-site:' || f.path || ':' || row_number() OVER (PARTITION BY e.file_id ORDER BY e.name, e.role, e.method, chunk_id) AS site FROM (
  SELECT DISTINCT id AS chunk_id, file_id, p[2] AS name, p[1] AS method, CASE WHEN p[1] IN ({', '.join(map(_q, E.EMITTERS))}) THEN 'emit' ELSE 'listen' END AS role FROM (
    SELECT id, file_id, unnest(list_zip(regexp_extract_all(content, {_q(E.EVENT)}, 1), regexp_extract_all(content, {_q(E.EVENT)}, 2))) AS p FROM chunks)
  WHERE p[1] IN ({', '.join(map(_q, E.EMITTERS + E.LISTENERS))})) e JOIN files f ON f.id = e.file_id)"""
EDGES = """calls AS (SELECT DISTINCT s.node_key AS src, r.file_id, r.kind, r.target_name FROM refk r JOIN sym s ON s.symbol_id = r.chunk_id),
rest AS (SELECT * FROM calls k WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.file_id = k.file_id AND s.name = k.target_name)),
free AS (SELECT * FROM rest k WHERE NOT EXISTS (SELECT 1 FROM imp i WHERE i.file_id = k.file_id AND i.local_name = k.target_name)),
bear AS (SELECT name, count(*) AS n FROM sym GROUP BY 1),
edges AS (
  SELECT 'file:' || path AS src_key, node_key AS dst_key, 'contains' AS kind, 'certain' AS confidence FROM sym
  UNION SELECT 'file:' || f.path, 'pkg:' || m.package, CASE WHEN m.type_only THEN 'imports_package_types' ELSE 'import' END, 'certain' FROM mod m JOIN files f ON f.id = m.from_file WHERE m.package IS NOT NULL
  UNION SELECT 'file:' || f.path, 'file:' || t.path, CASE WHEN m.type_only THEN 'imports_types' ELSE 'import' END, 'certain' FROM mod m JOIN files f ON f.id = m.from_file JOIN files t ON t.id = m.to_file
  UNION SELECT k.src, s.node_key, k.kind, 'certain' FROM calls k JOIN sym s ON s.file_id = k.file_id AND s.name = k.target_name WHERE s.node_key <> k.src
  UNION SELECT k.src, 'pkg:' || i.package, k.kind, 'likely' FROM rest k JOIN imp i ON i.file_id = k.file_id AND i.local_name = k.target_name WHERE i.package IS NOT NULL
  UNION SELECT k.src, s.node_key, k.kind, 'certain' FROM rest k JOIN imp i ON i.file_id = k.file_id AND i.local_name = k.target_name JOIN mod m ON m.from_file = i.file_id AND m.request = i.request
    JOIN chain c ON c.file_id = m.to_file AND c.export_name = i.imported_name JOIN sym s ON s.file_id = c.def_file AND s.name = c.def_name
  UNION SELECT k.src, s.node_key, k.kind, 'possible' FROM free k JOIN sym s ON s.name = k.target_name JOIN bear b ON b.name = s.name WHERE b.n <= 3
  UNION SELECT k.src, 'name:unknown:' || k.target_name, k.kind, 'possible' FROM free k JOIN bear b ON b.name = k.target_name WHERE b.n > 3
  UNION SELECT 'name:unknown:' || s.name, s.node_key, 'name_candidate', 'possible' FROM sym s JOIN bear b USING (name) WHERE b.n > 3 AND s.name IN (SELECT target_name FROM free)
  UNION SELECT s.node_key, 'member:unknown:' || m.prop, 'member_call', 'possible' FROM mem m JOIN sym s ON s.symbol_id = m.chunk_id WHERE m.prop IN (SELECT name FROM sym)
  UNION SELECT 'member:unknown:' || s.name, s.node_key, 'member_candidate', 'possible' FROM sym s WHERE s.name IN (SELECT prop FROM mem)
  UNION SELECT 'file:' || path, site, 'contains_event', 'certain' FROM evt
  UNION SELECT CASE WHEN role = 'emit' THEN site ELSE 'event:unknown:' || name END, CASE WHEN role = 'emit' THEN 'event:unknown:' || name ELSE site END, CASE WHEN role = 'emit' THEN 'emits' ELSE 'listens' END, 'possible' FROM evt)"""
MODULES = f"WITH RECURSIVE {IMP}, {EXP}, {MOD}, {CHAIN}"
BASE = f"WITH RECURSIVE {SYM}, {REF}, {MEM}, {IMP}, {EXP}, {MOD}, {CHAIN}, {EVT}, {EDGES}"
ENDS = """ends AS (SELECT src_key AS node, dst_key AS other, kind, confidence FROM edges UNION ALL
  SELECT dst_key, src_key, kind, confidence FROM edges WHERE src_key <> dst_key),
deg AS (SELECT node, count(*) AS degree, count(DISTINCT CASE WHEN node <> other THEN other END) AS neighbours FROM ends GROUP BY 1)"""


def symbols(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "symbols", lambda: E.symbols(table(s, d, "chunks"), table(s, d, "files")))


def imports(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "imports", lambda: E.imports(table(s, d, "source_files")))


def exports(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "exports", lambda: E.exports(table(s, d, "source_files")))


def typed_references(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "references", lambda: E.typed_references(table(s, d, "chunks")))


def member_calls(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "member_calls", lambda: E.member_calls(table(s, d, "chunks")))


def event_sites(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "events", lambda: E.event_sites(table(s, d, "chunks")))


def modules(s: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        again = exports(s, d).filter("from_request IS NOT NULL").select("file_id", c("from_request").alias("request"), F.lit(False).alias("type_only"))
        return M.module_edges(table(s, d, "files"), imports(s, d).select("file_id", "request", "type_only").unionByName(again))

    return published(s, d, "modules", build)


def chains(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "chains", lambda: M.export_chains(s, M.linked_exports(exports(s, d), modules(s, d))))


def imported_definitions(s: SparkSession, d: str) -> DataFrame:
    """(file_id, local_name, def_file, def_name, confidence) of imports whose export chain ends at a definition."""
    to = modules(s, d).filter("to_file IS NOT NULL").select(c("from_file").alias("file_id"), "request", "to_file", "resolution")
    ends = chains(s, d).select(c("file_id").alias("to_file"), c("export_name").alias("imported_name"), "def_file", "def_name")
    rows = imports(s, d).filter("local_name IS NOT NULL").join(to, ["file_id", "request"]).join(ends, ["to_file", "imported_name"])
    return rows.select("file_id", "local_name", "def_file", "def_name", F.when(c("resolution") == "workspace", "likely").otherwise("certain").alias("confidence"))


def edges(s: SparkSession, d: str) -> DataFrame:
    """All edges, written once an application, as every graph query reads them."""

    def build() -> DataFrame:
        files, sym = table(s, d, "files"), symbols(s, d)
        return (
            G.contains_edges(sym).unionByName(G.import_edges(files, modules(s, d)))
            .unionByName(G.reference_edges(sym, typed_references(s, d), imports(s, d), imported_definitions(s, d)))
            .unionByName(G.member_edges(sym, member_calls(s, d))).unionByName(G.event_edges(files, event_sites(s, d)))
        )

    return published(s, d, "edges", build, ["kind", "dst_key"])


def degrees(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "degrees", lambda: Q.degrees(edges(s, d)))


def ends(s: SparkSession, d: str) -> DataFrame:
    """Edges from both ends with what scores them, sorted by node."""

    def build() -> DataFrame:
        roles = table(s, d, "files").select(F.concat(F.lit("file:"), "path").alias("node"), "role").unionByName(symbols(s, d).select(c("node_key").alias("node"), "role"))
        return Q.ends_table(edges(s, d), degrees(s, d), roles)

    return published(s, d, "ends", build, ["node"])


def anchor(degree: DataFrame, *more: str) -> DataFrame:
    """The node of the greatest degree, ties by key."""
    return degree.orderBy(c("degree").desc(), "node").limit(1).select(c("node").alias("root"), *more)


put("s8_symbols", f"WITH {SYM} SELECT symbol_id, node_key, kind, exported, line, ordinal FROM sym",
    lambda s, d: symbols(s, d).select("symbol_id", "node_key", "kind", "exported", "line", "ordinal"))
put("s8_references", f"WITH {REF} SELECT chunk_id, kind, target_name, n FROM refk", lambda s, d: E.typed_references(table(s, d, "chunks")).select("chunk_id", "kind", "target_name", "n"))
put("s8_s9_imports", f"WITH {IMP} SELECT file_id, local_name, imported_name, request, package, type_only FROM imp", imports)
put("s8_exports", f"WITH {EXP} SELECT * FROM exp", exports)
put("g1_module_edges", MODULES + " SELECT * FROM mod", modules)
put("g2_j11_export_chains", MODULES + " SELECT * FROM chain", chains)
put("g12_event_edges", f"WITH {EVT} SELECT 'file:' || path AS src_key, site AS dst_key, 'contains_event' AS kind, 'certain' AS confidence FROM evt UNION ALL SELECT site, 'event:unknown:' || name, 'emits', 'possible' FROM evt WHERE role = 'emit' UNION ALL SELECT 'event:unknown:' || name, site, 'listens', 'possible' FROM evt WHERE role = 'listen'",
    lambda s, d: edges(s, d).filter(c("kind").isin("contains_event", "emits", "listens")))
put("s9_member_calls", f"WITH {MEM} SELECT chunk_id, object, prop, n FROM mem", lambda s, d: E.member_calls(table(s, d, "chunks")).select("chunk_id", "object", "prop", "n"))
put("s9_q14_event_sites", f"""WITH e AS (SELECT id AS chunk_id, file_id, unnest(list_zip(regexp_extract_all(content, {_q(E.EVENT)}, 1), regexp_extract_all(content, {_q(E.EVENT)}, 2))) AS p FROM chunks)
SELECT DISTINCT chunk_id, p[2] AS name, p[1] AS method, CASE WHEN p[1] IN ({', '.join(map(_q, E.EMITTERS))}) THEN 'emit' ELSE 'listen' END AS role
FROM e WHERE p[1] IN ({', '.join(map(_q, E.EMITTERS + E.LISTENERS))})""",
    lambda s, d: E.event_sites(table(s, d, "chunks")).select("chunk_id", "name", "method", "role"))
put("g3_nodes", f"""WITH {SYM}, {IMP} SELECT 'file:' || path AS node_key, 'file' AS node_kind, path AS display_name FROM files
UNION ALL SELECT node_key, 'symbol', name FROM sym UNION ALL SELECT DISTINCT 'pkg:' || package, 'package', package FROM imp WHERE package IS NOT NULL""",
    lambda s, d: G.nodes(table(s, d, "files"), symbols(s, d), imports(s, d)).select("node_key", "node_kind", "display_name"))
for _name, _kinds in {"g4_import_edges": ["import", "imports_types", "imports_package_types"], "g5_j21_reference_edges": ["call", "extend", "render", "name_candidate"], "g10_member_hubs": ["member_call", "member_candidate"]}.items():
    put(_name, BASE + f" SELECT src_key, dst_key, kind, confidence FROM edges WHERE kind IN ({', '.join(map(_q, _kinds))})",
        lambda s, d, k=_kinds: edges(s, d).filter(c("kind").isin(k)))
put("a16_a17_degree", BASE + f", {ENDS} SELECT node, degree, neighbours FROM deg", lambda s, d: degrees(s, d))
put("a4_edges_per_kind", BASE + " SELECT kind, count(*) AS n FROM edges GROUP BY 1", lambda s, d: edges(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
put("a10_weighted_in_degree", BASE + " SELECT dst_key, round(sum(CASE confidence WHEN 'certain' THEN 1.0 WHEN 'likely' THEN 0.6 ELSE 0.3 END), 6)::DOUBLE AS weight FROM edges GROUP BY 1",
    lambda s, d: edges(s, d).groupBy("dst_key").agg(F.round(F.sum(X.confidence_weight(c("confidence"))), 6).alias("weight")))
_REL = "CASE kind WHEN 'call' THEN 1.0 WHEN 'member_call' THEN 0.9 WHEN 'member_candidate' THEN 0.9 WHEN 'name_candidate' THEN 0.9 WHEN 'extend' THEN 1.0 WHEN 'render' THEN 1.0 WHEN 'import' THEN 0.75 WHEN 'emits' THEN 0.7 WHEN 'listens' THEN 0.7 WHEN 'imports_types' THEN 0.6 WHEN 'imports_package_types' THEN 0.6 WHEN 'contains_event' THEN 0.6 ELSE 0.5 END"
put("q2_one_hop_neighborhood", BASE + f""", {ENDS},
root AS (SELECT node AS root, degree AS rd FROM deg ORDER BY degree DESC, node LIMIT 1)
SELECT root, other, kind, confidence, round(least(1.0 / log2(rd + 2), CASE confidence WHEN 'certain' THEN 1.0 WHEN 'likely' THEN 0.6 ELSE 0.3 END) * {_REL} * (1.0 / log2(deg.degree + 2)), 6)::DOUBLE AS relevance
FROM ends JOIN root ON ends.node = root.root JOIN deg ON deg.node = ends.other""",
    lambda s, d: Q.one_hop(edges(s, d), degrees(s, d), anchor(degrees(s, d))))
put("q6_bfs_distance", BASE + f""", {ENDS},
root AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1), pairs AS (SELECT DISTINCT node, other FROM ends),
d1 AS (SELECT DISTINCT other AS node FROM pairs JOIN root USING (node) WHERE other NOT IN (SELECT node FROM root)),
d2 AS (SELECT DISTINCT other AS node FROM pairs JOIN d1 USING (node) WHERE other NOT IN (SELECT node FROM root UNION ALL SELECT node FROM d1)),
d3 AS (SELECT DISTINCT other AS node FROM pairs JOIN d2 USING (node) WHERE other NOT IN (SELECT node FROM root UNION ALL SELECT node FROM d1 UNION ALL SELECT node FROM d2))
SELECT node, 0::BIGINT AS distance FROM root UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3""",
    lambda s, d: Q.distances(s, edges(s, d), anchor(degrees(s, d)).select(c("root").alias("node")), 3))


def around(s: SparkSession, d: str, depth: int, nodes: int, limit: int) -> tuple[str, list, list]:
    """The node of the greatest degree, and its best-first neighbourhood over all edges."""
    root, degree = anchor(degrees(s, d).select("node", "degree"), "degree").first()
    reader = Q.EdgeReader(s, ends(s, d), "possible")
    return (root, *Q.neighborhood(reader, root, 1 / math.log2(degree + 2), depth, nodes, limit))


def q2_neighborhood(s: SparkSession, d: str) -> DataFrame:
    _, found, _ = around(s, d, 2, 50, 200)
    return s.createDataFrame([(n, float(x), k, i + 1) for i, (n, x, k) in enumerate(found)], "node string, relevance double, depth long, rank long")


def q3_paths(s: SparkSession, d: str) -> DataFrame:
    root, found, scored = around(s, d, 3, 200, 800)
    goal = max(found, key=lambda x: (x[2], -x[1], x[0]))[0]
    paths = Q.ranked_paths(scored, root, goal)
    return s.createDataFrame([(i + 1, float(x), len(p), " > ".join(p)) for i, (x, p) in enumerate(paths)], "rank long, score double, length long, path string")


def q7_widest(s: SparkSession, d: str) -> DataFrame:
    root, _, scored = around(s, d, 2, 200, 800)
    wide = Q.widest_paths(scored, [root])
    return s.createDataFrame([(n, float(x), b) for n, (x, b) in sorted(wide.items()) if n != root], "node string, bottleneck double, predecessor string")


put("q2_neighborhood_best_first", None, q2_neighborhood)
put("q3_ranked_paths", None, q3_paths)
put("q7_widest_paths", None, q7_widest)

_USES = "('call', 'extend', 'render')"
put("q9_who_uses_by_name", BASE + f""" SELECT name, count(DISTINCT src_key) AS n_users FROM (SELECT s.name, e.src_key FROM edges e JOIN sym s ON s.node_key = e.dst_key WHERE e.kind IN {_USES}
UNION ALL SELECT b.name, e.src_key FROM edges e JOIN bear b ON e.dst_key = 'name:unknown:' || b.name WHERE e.kind IN {_USES}) GROUP BY 1""",
    lambda s, d: (lambda e: e.join(symbols(s, d).select(c("node_key").alias("dst_key"), "name"), "dst_key").select("name", "src_key").unionByName(
        e.filter(c("dst_key").startswith("name:unknown:")).select(F.expr("substring(dst_key, 14)").alias("name"), "src_key")).groupBy("name").agg(
        F.count_distinct("src_key").alias("n_users")))(edges(s, d).filter(f"kind IN {_USES}")))
put("q10_j17_users_through_hubs", BASE + """ SELECT DISTINCT a.src_key AS user_key, b.dst_key AS target_key FROM edges a JOIN edges b ON b.src_key = a.dst_key
WHERE a.kind = 'member_call' AND b.kind = 'member_candidate' AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.kind = 'call' AND x.src_key = a.src_key AND x.dst_key = b.dst_key)""",
    lambda s, d: (lambda e: e.filter("kind = 'member_call'").select(c("src_key").alias("user_key"), c("dst_key").alias("_h")).join(
        e.filter("kind = 'member_candidate'").select(c("src_key").alias("_h2"), c("dst_key").alias("target_key")), c("_h") == c("_h2")).select("user_key", "target_key").distinct().join(
        e.filter("kind = 'call'").select(c("src_key").alias("user_key"), c("dst_key").alias("target_key")), ["user_key", "target_key"], "left_anti"))(edges(s, d)))
put("q11_find_symbols", f"WITH {SYM} SELECT symbol_id, name, path, line, row_number() OVER (ORDER BY exported DESC, path, line NULLS FIRST, kind, symbol_id) AS rank FROM sym WHERE contains(name, 'Invoice')",
    lambda s, d: symbols(s, d).filter(c("name").contains("Invoice")).select("symbol_id", "name", "path", "line",
        F.row_number().over(Window.orderBy(c("exported").desc(), "path", "line", "kind", "symbol_id")).cast("long").alias("rank")))
put("q13_file_outline", f"SELECT c.id AS chunk_id, c.file_id, {KIND.replace('kind', 'c.kind')} AS kind, c.name, row_number() OVER (PARTITION BY c.file_id ORDER BY c.start_byte, c.id) AS position FROM chunks c",
    lambda s, d: table(s, d, "chunks").select(c("id").alias("chunk_id"), "file_id", E.kind_name(c("kind")).alias("kind"), "name",
        F.row_number().over(Window.partitionBy("file_id").orderBy("start_byte", "id")).cast("long").alias("position")))
put("q15_call_sites", f"""WITH {MEM}, f AS (SELECT chunk_id FROM mem WHERE prop = 'push' GROUP BY 1 INTERSECT SELECT chunk_id FROM mem WHERE object = 'log' GROUP BY 1)
SELECT m.chunk_id, m.object, m.prop, m.n FROM mem m WHERE m.prop = 'push' AND m.object = 'log' AND m.chunk_id IN (SELECT chunk_id FROM f)""",
    lambda s, d: (lambda m: m.filter("prop = 'push' AND object = 'log'").select("chunk_id", "object", "prop", "n"))(E.member_calls(table(s, d, "chunks"))))
put("u4_term_intersection", """SELECT file_id FROM (SELECT file_id, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z0-9_$]+'))) AS t FROM chunks)
WHERE t IN ('log', 'push', 'reduce') GROUP BY 1 HAVING count(DISTINCT t) = 3""",
    lambda s, d: table(s, d, "chunks").select("file_id", F.explode(F.array_distinct(X.identifier_tokens(c("content")))).alias("t")).filter(
        c("t").isin("log", "push", "reduce")).groupBy("file_id").agg(F.count_distinct("t").alias("n")).filter("n = 3").select("file_id"))

# --- interval joins over chunks of one file ---------------------------------------------------------------------

_METHODS = f"m AS (SELECT id, file_id, start_byte FROM chunks WHERE {KIND} = 'method'), o AS (SELECT id, file_id, start_byte, end_byte, start_line, end_line FROM chunks WHERE {KIND} IN ('class', 'class_header', 'function', 'module'))"


def _methods(s, d):
    return table(s, d, "chunks").filter(E.kind_name(c("kind")) == "method")


def _outer(s, d):
    return table(s, d, "chunks").filter(E.kind_name(c("kind")).isin("class", "class_header", "function", "module"))


def _mid(s, d):
    """An offset inside each chunk."""
    return table(s, d, "chunks").filter("start_byte IS NOT NULL AND end_byte > start_byte").withColumn("at", F.expr("start_byte + (end_byte - start_byte) div 2"))


put("j4_innermost_container", """SELECT p.id, min_by(c.id, (c.end_byte - c.start_byte, c.start_byte, c.id)) AS container, min(c.end_byte - c.start_byte) AS width
FROM (SELECT id, file_id, start_byte + (end_byte - start_byte) // 2 AS at FROM chunks WHERE end_byte > start_byte) p
JOIN chunks c ON c.file_id = p.file_id AND p.at >= c.start_byte AND p.at < c.end_byte GROUP BY 1""",
    lambda s, d: I.innermost(_mid(s, d), table(s, d, "chunks"), "file_id", "at", "start_byte", "end_byte", "id", "id"))
put("j5_first_container", """SELECT p.id, arg_min(c.id, (c.start_byte, c.id)) AS container FROM (SELECT id, file_id, start_byte + (end_byte - start_byte) // 2 AS at FROM chunks WHERE end_byte > start_byte) p
JOIN chunks c ON c.file_id = p.file_id AND c.start_byte <= p.at AND p.at < c.end_byte GROUP BY 1""",
    lambda s, d: _mid(s, d).select(c("id").alias("pid"), c("file_id").alias("pf"), "at").join(table(s, d, "chunks"), (c("pf") == c("file_id")) & (c("start_byte") <= c("at")) & (c("at") < c("end_byte"))).groupBy(
        c("pid").alias("id")).agg(F.min(F.struct("start_byte", c("id").alias("k"))).alias("b")).select("id", c("b.k").alias("container")))
put("j7_byte_overlap", """SELECT a.id AS left_key, b.id AS right_key FROM chunks a JOIN chunks b ON a.file_id = b.file_id AND a.start_byte < b.end_byte AND a.end_byte > b.start_byte WHERE a.id < b.id""",
    lambda s, d: I.overlapping(table(s, d, "chunks"), table(s, d, "chunks"), "file_id", "start_byte", "end_byte", "id", "id").filter("left_key < right_key").select("left_key", "right_key"))
put("j8_line_overlap", """SELECT a.id AS left_key, b.id AS right_key FROM chunks a JOIN chunks b ON a.file_id = b.file_id AND a.start_line <= b.end_line AND a.end_line >= b.start_line WHERE a.id < b.id""",
    lambda s, d: I.overlapping(table(s, d, "chunks"), table(s, d, "chunks"), "file_id", "start_line", "end_line", "id", "id", True).filter("left_key < right_key").select("left_key", "right_key"))
put("j9_next_within_512", """SELECT a.id, arg_min(b.id, (b.start_byte, b.id)) AS target, min(b.start_byte) AS target_start FROM chunks a JOIN chunks b ON a.file_id = b.file_id
AND b.start_byte >= a.end_byte AND b.start_byte - a.end_byte <= 512 GROUP BY 1""",
    lambda s, d: I.next_within(table(s, d, "chunks"), table(s, d, "chunks"), "file_id", "end_byte", "start_byte", "id", "id", 512))
put("j19_j20_longest_prefix_owner", """WITH roots AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS root FROM files, (VALUES (2), (3)) v(k) WHERE path LIKE 'packages/%' AND len(string_split(path, '/')) > k),
h AS (SELECT f.id, r.root, row_number() OVER (PARTITION BY f.id ORDER BY length(r.root) DESC, r.root) AS n FROM files f JOIN roots r ON starts_with(f.path, r.root || '/'))
SELECT id, root FROM h WHERE n = 1""",
    lambda s, d: (lambda f: I.longest_prefix(f, f.filter(c("path").startswith("packages/")).select(F.explode(F.array(F.lit(2), F.lit(3))).alias("k"), "path").filter(F.size(F.split("path", "/")) > c("k")).select(
        F.array_join(F.slice(F.split("path", "/"), F.lit(1), c("k")), "/").alias("root")).distinct(), "path", "id", "root", "root").select("id", "root"))(table(s, d, "files")))
