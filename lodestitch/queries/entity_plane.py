"""Entities over the indexed sources, traversal across them, and the rest of the graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import entities as N
from ..operators import graph_build as G
from ..operators import graph_query as Q
from ..session import published, table
from .graph import BASE, ENDS, SYM, anchor, degrees, edges, symbols
from .registry import Registry

REG = Registry()
c = F.col


def put(name, sql, f):
    REG.add(name, sql)(f)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ONE = " UNION ALL ".join(
    f"SELECT file_id, {_q(plane)} AS plane, {_q(kind_)} AS entity_type, {_q(role)} AS role, unnest(regexp_extract_all(content, {_q(p)}, 1)) AS name, {_q(edge)} AS kind FROM source_files"
    for p, plane, kind_, role, edge in N.SITES
)
SITE = f"site AS (SELECT file_id, plane, entity_type, role, name, kind, count(*) AS n FROM ({_ONE}) GROUP BY ALL)"


def sites(s: SparkSession, d: str) -> DataFrame:
    return published(s, d, "sites", lambda: N.sites(table(s, d, "source_files")))


def producer_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls of symbols in files with a producing site, those through name hubs included."""
    files = sites(s, d).filter(c("role").isin(N.PRODUCERS)).select("file_id").distinct()
    return G.callers(edges(s, d), symbols(s, d).join(files, "file_id", "left_semi"))


put("s10_entity_sites", f"WITH {SITE} SELECT * FROM site", sites)
put("g6_entities", f"WITH {SITE} SELECT plane, entity_type, name, count(DISTINCT file_id) AS n_files, sum(n)::BIGINT AS n_occurrences FROM site GROUP BY ALL",
    lambda s, d: N.entities(sites(s, d)).drop("entity_key"))
put("g7_g9_entity_edges", f"""WITH {SITE}, e AS (SELECT DISTINCT f.path, entity_type, name, kind, plane, site.role IN ({', '.join(map(_q, N.CONSUMERS))}) AS takes FROM site JOIN files f ON f.id = site.file_id)
SELECT kind, CASE WHEN plane = 'contract' THEN 'certain' ELSE 'likely' END AS confidence, takes AS from_entity, count(*) AS n FROM e GROUP BY ALL""",
    lambda s, d: N.entity_edges(sites(s, d), table(s, d, "files")).groupBy("kind", "confidence", c("src_key").startswith("entity:").alias("from_entity")).agg(F.count(F.lit(1)).alias("n")))
put("q4_entity_crossings", f"""WITH {SITE}, per AS (SELECT DISTINCT entity_type, name, plane, role, file_id FROM site WHERE plane <> 'contract'),
few AS (SELECT entity_type, name FROM per GROUP BY ALL HAVING count(DISTINCT file_id) BETWEEN 2 AND {N.HUB_LIMIT})
SELECT DISTINCT a.entity_type, a.name, a.file_id AS from_file, b.file_id AS to_file FROM per a JOIN few USING (entity_type, name) JOIN per b USING (entity_type, name)
WHERE a.file_id <> b.file_id AND (a.plane = 'general' OR (a.role IN ({', '.join(map(_q, N.PRODUCERS))}) AND b.role IN ({', '.join(map(_q, N.CONSUMERS))})))""",
    lambda s, d: N.crossings(sites(s, d)))
put("q5_workflow_candidates", f"""WITH {SITE}, {SYM}, w AS (SELECT file_id, round(max(1.0 / log2(n + 2)), 6) AS relevance FROM site WHERE plane <> 'contract' GROUP BY 1)
SELECT s.node_key, w.relevance, row_number() OVER (ORDER BY w.relevance DESC, s.node_key) AS rank FROM sym s JOIN w USING (file_id) WHERE s.exported AND s.role = 'production' ORDER BY rank LIMIT 31""",
    lambda s, d: (lambda w: symbols(s, d).filter(c("exported") & (c("role") == "production")).join(w, "file_id").orderBy(c("relevance").desc(), "node_key").limit(31).select(
        "node_key", "relevance", F.row_number().over(Window.orderBy(c("relevance").desc(), "node_key")).cast("long").alias("rank")))(
        sites(s, d).filter("plane <> 'contract'").groupBy("file_id").agg(F.max(X.round_score(X.hub_damping(c("n")))).alias("relevance"))))
put("g8_boundary_collapse", BASE + f""", {SITE}, p AS (SELECT DISTINCT 'sym' AS k, s.node_key, t.name FROM site t JOIN sym s USING (file_id) WHERE t.role IN ({', '.join(map(_q, N.PRODUCERS))}))
SELECT DISTINCT e.src_key, p.name AS entity, e.confidence FROM edges e JOIN p ON p.node_key = e.dst_key WHERE e.kind = 'call'
UNION SELECT e.src_key, p.name, e.confidence FROM edges e JOIN edges h ON h.src_key = e.dst_key AND h.kind = 'name_candidate' JOIN p ON p.node_key = h.dst_key WHERE e.kind = 'call' AND e.src_key <> h.dst_key""",
    lambda s, d: producer_calls(s, d).join(symbols(s, d).select(c("node_key").alias("dst_key"), "file_id").join(
        sites(s, d).filter(c("role").isin(N.PRODUCERS)).select("file_id", c("name").alias("entity")), "file_id").select("dst_key", "entity").distinct(), "dst_key").select("src_key", "entity", "confidence").distinct())
put("t7_diverse_ties", """WITH a AS (SELECT DISTINCT id, artifact_type, confidence FROM artifact_views WHERE is_current),
t AS (SELECT *, row_number() OVER (PARTITION BY confidence, artifact_type ORDER BY id) AS turn FROM a)
SELECT id, confidence, row_number() OVER (PARTITION BY confidence ORDER BY turn, id) AS pick FROM t""",
    lambda s, d: N.diverse(table(s, d, "artifact_views").filter("is_current").select("id", "artifact_type", "confidence").distinct(), ["confidence"], [c("id")], "artifact_type").select("id", "confidence", "pick"))
put("q8_u8_expansion", BASE + f""", {ENDS}, seeds AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 3),
hop AS (SELECT e.other AS node, round(CASE e.confidence WHEN 'certain' THEN 1.0 WHEN 'likely' THEN 0.6 ELSE 0.3 END * (1.0 / log2(deg.degree + 2)), 6)::DOUBLE AS relevance FROM ends e JOIN seeds USING (node) JOIN deg ON deg.node = e.other)
SELECT node, max(relevance) AS relevance FROM hop GROUP BY 1""",
    lambda s, d: (lambda e: (lambda g: Q.endpoints(e).join(F.broadcast(g.orderBy(c("degree").desc(), "node").limit(3).select("node")), "node").select(c("other").alias("_o"), "confidence").join(
        g.select(c("node").alias("_o"), "degree"), "_o").groupBy(c("_o").alias("node")).agg(F.max(X.round_score(X.confidence_weight(c("confidence")) * X.hub_damping(c("degree")))).alias("relevance")))(degrees(s, d)))(edges(s, d)))
put("q1_anchor_resolution", f"WITH {SYM} SELECT name, count(*) AS n_candidates, CASE WHEN count(*) = 1 THEN min(node_key) END AS anchor FROM sym GROUP BY 1",
    lambda s, d: symbols(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("node_key").alias("k")).select("name", "n_candidates", F.when(c("n_candidates") == 1, c("k")).alias("anchor")))
put("q12_definitions", f"WITH {SYM}, r AS (SELECT name, symbol_id, row_number() OVER (PARTITION BY name ORDER BY decl_end - decl_start, symbol_id) AS rank FROM sym) SELECT name, symbol_id, rank FROM r WHERE rank <= 5",
    lambda s, d: symbols(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(c("decl_end") - c("decl_start"), "symbol_id")).cast("long")).filter("rank <= 5").select("name", "symbol_id", "rank"))
put("z31_node_lookup", f"WITH {SYM} SELECT node_key, split_part(substr(node_key, 5), '#', 1) AS path, regexp_extract(node_key, '::(.*)@([0-9]+)$', 1) AS name FROM sym",
    lambda s, d: symbols(s, d).select("node_key", F.split_part(F.expr("substring(node_key, 5)"), F.lit("#"), F.lit(1)).alias("path"), F.regexp_extract("node_key", "::(.*)@([0-9]+)$", 1).alias("name")))
