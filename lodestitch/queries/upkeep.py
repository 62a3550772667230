"""Batches, guards, policies, memory answers, phases and lookups over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import evidence as E
from ..operators import graph_query as Q
from ..operators import intervals as I
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import upkeep as U
from ..operators.skew import positions
from ..session import table
from ..sources import files as S
from ..sources import tables as T
from ..streaming import watch as L
from .entity_plane import SITE, sites
from .graph import BASE, REF, SYM, degrees, edges, symbols
from .planes import ART, artifacts, links
from .registry import Registry

REG = Registry()
c = F.col


def put(name, sql, f):
    REG.add(name, sql)(f)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def t(name: str):
    return lambda s, d: table(s, d, name)


files, chunks, packages, sources, scores = t("files"), t("chunks"), t("package_instances"), t("source_files"), t("artifact_scores")

# --- sources and sinks ------------------------------------------------------------------------------------------

put("s19_rewrite_or_delete", "SELECT repo, count(*) AS n, count(*) FILTER (role = 'generated' OR role IS NULL) AS changed, 2 * count(*) FILTER (role = 'generated' OR role IS NULL) >= count(*) AS rewrite FROM files GROUP BY 1",
    lambda s, d: files(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if((c("role") == "generated") | c("role").isNull()).alias("changed")).withColumn("rewrite", 2 * c("changed") >= c("n")))
put("s24_gateway_answers", """WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), k AS (SELECT user_id, min(n) FILTER (event_type <> 'error') AS f, max(n) AS m FROM a WHERE n <= 3 GROUP BY 1)
SELECT user_id, f IS NOT NULL AS answered, coalesce(f, m)::BIGINT AS tries FROM k""",
    lambda s, d: U.first_answers(table(s, d, "events"), "user_id", [c("ts"), c("event_id")], c("event_type") != "error"))

# --- filters, joins, limits -------------------------------------------------------------------------------------

_RANKED = "rk AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM (SELECT query_id, artifact_id, max(rank_score) AS score FROM artifact_scores WHERE rank_score IS NOT NULL GROUP BY 1, 2))"


def ranked(s, d):
    best = scores(s, d).filter("rank_score IS NOT NULL").groupBy("query_id", "artifact_id").agg(F.max("rank_score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "artifact_id")).cast("long")).drop("score")


put("f8_overfetch_late_filter", f"""WITH {ART}, {_RANKED}, p AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM rk JOIN art ON art.id = artifact_id WHERE rank <= 200 AND artifact_type = 'card')
SELECT query_id, artifact_id, place, n < 5 AS exhausted FROM p WHERE place <= 5""",
    lambda s, d: U.overfetched(ranked(s, d).join(artifacts(s, d).select(c("id").alias("artifact_id"), "artifact_type"), "artifact_id"), "query_id", c("artifact_type") == "card", 5).select("query_id", "artifact_id", "place", "exhausted"))
put("j6_exact_span", f"""WITH {SYM} SELECT s.symbol_id, arg_min(c.id, (c.end_byte - c.start_byte, c.id)) AS chunk_id FROM sym s JOIN chunks c ON c.file_id = s.file_id AND c.start_byte <= s.decl_start AND s.decl_end <= c.end_byte GROUP BY 1""",
    lambda s, d: (lambda a: a.join(chunks(s, d).select(c("id").alias("k"), c("file_id").alias("f"), "start_byte", "end_byte"), (c("f") == c("file_id")) & (c("start_byte") <= c("decl_start")) & (c("decl_end") <= c("end_byte"))).groupBy("symbol_id").agg(
        F.min(F.struct((c("end_byte") - c("start_byte")).alias("w"), "k")).alias("b")).select("symbol_id", c("b.k").alias("chunk_id")))(symbols(s, d).select("symbol_id", "file_id", "decl_start", "decl_end")))
put("t2_merge_lists", f"""WITH {_RANKED}, m AS (SELECT artifact_id, min(rank) AS rank FROM rk GROUP BY 1) SELECT artifact_id, rank AS best, row_number() OVER (ORDER BY rank, artifact_id) AS place FROM m ORDER BY place LIMIT 25""",
    lambda s, d: R.top(ranked(s, d).groupBy("artifact_id").agg(F.min("rank").alias("best")), [c("best"), c("artifact_id")], 25).withColumnRenamed("rank", "place"))
put("t5_budgeted_shedding", """WITH p AS (SELECT f.repo, coalesce(f.role, 'none') AS tier, sum(strlen(s.content))::BIGINT AS bytes FROM files f JOIN source_files s ON s.file_id = f.id WHERE s.content IS NOT NULL GROUP BY 1, 2)
SELECT repo, tier, bytes, sum(bytes) OVER (PARTITION BY repo ORDER BY tier ROWS UNBOUNDED PRECEDING) <= 40000 AS kept FROM p""",
    lambda s, d: U.shed(files(s, d).select(c("id").alias("file_id"), "repo", F.coalesce("role", F.lit("none")).alias("tier")).join(sources(s, d).filter("content IS NOT NULL").select("file_id", F.octet_length("content").cast("long").alias("size")), "file_id"), "repo", "tier", "size", 40_000))
put("x9_round_score", "SELECT query_id, artifact_id, round(max(rank_score), 6) AS score FROM artifact_scores WHERE rank_score IS NOT NULL GROUP BY 1, 2",
    lambda s, d: scores(s, d).filter("rank_score IS NOT NULL").groupBy("query_id", "artifact_id").agg(F.max("rank_score").alias("m")).select("query_id", "artifact_id", X.round_score(c("m")).alias("score")))
put("x17_router_methods", """SELECT chunk_id, lower(p[1]) AS holder, upper(p[2]) AS method FROM (SELECT id AS chunk_id, unnest(list_zip(regexp_extract_all(content, '([A-Za-z_$][\\w$]*)\\.([A-Za-z_$][\\w$]*)\\s*\\(', 1), regexp_extract_all(content, '([A-Za-z_$][\\w$]*)\\.([A-Za-z_$][\\w$]*)\\s*\\(', 2))) AS p FROM chunks)
WHERE lower(p[2]) IN ('get', 'post', 'put', 'patch', 'delete', 'head', 'options', 'all') AND (lower(p[1]) IN ('app', 'router', 'server', 'fastify', 'api', 'routes') OR suffix(lower(p[1]), 'router')) GROUP BY ALL""",
    lambda s, d: E.member_calls(chunks(s, d)).filter(U.is_router_holder(c("object")) & U.http_method(c("prop")).isNotNull()).select("chunk_id", F.lower("object").alias("holder"), U.http_method(c("prop")).alias("method")).distinct())
_LIT = r"""'[^'\n]*'|"[^"\n]*"|`[^`\n]*`"""
put("x18_static_strings", rf"""WITH l AS (SELECT id AS chunk_id, unnest(regexp_extract_all(content, {q(_LIT)})) AS x FROM chunks),
f AS (SELECT chunk_id, x, regexp_replace(x, {q(r"\$\{\s*['" + chr(34) + r"]([^'" + chr(34) + r"]*)['" + chr(34) + r"]\s*\}")}, '\1', 'g') AS y FROM l)
SELECT chunk_id, value, count(*) AS n FROM (SELECT chunk_id, CASE WHEN left(x, 1) <> '`' AND NOT contains(x, '\') THEN substr(x, 2, length(x) - 2) WHEN left(x, 1) = '`' AND NOT contains(y, '\') AND NOT contains(y, '$') THEN substr(y, 2, length(y) - 2) END AS value FROM f) WHERE value IS NOT NULL GROUP BY ALL""",
    lambda s, d: chunks(s, d).select(c("id").alias("chunk_id"), F.explode(F.regexp_extract_all("content", F.lit(_LIT), 0)).alias("x")).select("chunk_id", U.static_string(c("x")).alias("value")).filter("value IS NOT NULL").groupBy("chunk_id", "value").agg(F.count(F.lit(1)).alias("n")))
put("x20_parsed_keys", f"WITH {SYM} SELECT node_key, 'sym' AS kind, path, scope, name, ordinal FROM sym",
    lambda s, d: symbols(s, d).select("node_key", U.parsed_key(c("node_key")).alias("p")).select("node_key", "p.kind", "p.path", "p.scope", "p.name", "p.ordinal"))

# --- retrieval and memory ---------------------------------------------------------------------------------------

_KNN = """SELECT vec_id, profile_id, vec FROM (SELECT e.vec_id, e.profile_id, e.vec, row_number() OVER (PARTITION BY vec_id ORDER BY e.created_at DESC) AS n FROM semantic_embeddings e JOIN embedding_profiles p ON p.id = e.profile_id
  WHERE e.vec IS NOT NULL AND len(e.vec) = p.dimensions AND isfinite(list_dot_product(e.vec::DOUBLE[], e.vec::DOUBLE[])) AND list_dot_product(e.vec::DOUBLE[], e.vec::DOUBLE[]) > 0) WHERE n = 1"""


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda u, v: u + v)


def vectors(s, d):
    """(vec_id, profile_id, vec, norm) of usable vectors, the newest of an id."""
    dims = F.broadcast(table(s, d, "embedding_profiles").select(c("id").alias("profile_id"), "dimensions"))
    good = table(s, d, "semantic_embeddings").join(dims, "profile_id").filter(c("vec").isNotNull() & (F.size("vec") == c("dimensions"))).withColumn("norm", F.sqrt(_dot("vec", "vec")))
    return good.filter((c("norm") > 0) & ~F.isnan("norm") & (c("norm") < float("inf"))).groupBy("vec_id").agg(F.max_by(F.struct("profile_id", "vec", "norm"), "created_at").alias("b")).select("vec_id", "b.*")


def nearest(s, d, profile: int, limit: int) -> DataFrame:
    """Exact nearest vectors of one profile to the vector of its least id, that one aside."""
    mine = vectors(s, d).filter(c("profile_id") == profile)
    probe = mine.orderBy("vec_id").limit(1).select(c("vec_id").alias("_p"), c("vec").alias("_v"), c("norm").alias("_n"))
    near = mine.crossJoin(F.broadcast(probe)).filter("vec_id <> _p").select("vec_id", F.round(_dot("vec", "_v") / (c("norm") * c("_n")), 6).alias("cosine"))
    return R.top(near, [c("cosine").desc(), c("vec_id")], limit)


def _near_sql(profile: int) -> str:
    return f"v AS ({_KNN}), mine AS (SELECT * FROM v WHERE profile_id = {profile}), probe AS (SELECT * FROM mine ORDER BY vec_id LIMIT 1), near AS (SELECT m.vec_id, round(list_dot_product(m.vec::DOUBLE[], p.vec::DOUBLE[]) / sqrt(list_dot_product(m.vec::DOUBLE[], m.vec::DOUBLE[]) * list_dot_product(p.vec::DOUBLE[], p.vec::DOUBLE[])), 6) AS cosine FROM mine m, probe p WHERE m.vec_id <> p.vec_id)"


put("s16_knn_of_a_profile", f"WITH {_near_sql(2)} SELECT vec_id, cosine, row_number() OVER (ORDER BY cosine DESC, vec_id) AS rank FROM near ORDER BY rank LIMIT 10", lambda s, d: nearest(s, d, 2, 10))
put("v2_artifact_knn", f"""WITH {ART}, {_near_sql(1)}, k AS (SELECT vec_id, cosine FROM near ORDER BY cosine DESC, vec_id LIMIT 80)
SELECT vec_id AS artifact_id, cosine, row_number() OVER (ORDER BY cosine DESC, vec_id) AS rank FROM k JOIN art ON art.id = vec_id WHERE vec_id NOT IN (SELECT supersedes FROM art WHERE supersedes IS NOT NULL) ORDER BY rank LIMIT 20""",
    lambda s, d: R.top(nearest(s, d, 1, min(4 * 20, 4096)).select(c("vec_id").alias("artifact_id"), "cosine").join(M.current(artifacts(s, d)).select(c("id").alias("artifact_id")), "artifact_id", "left_semi"), [c("cosine").desc(), c("artifact_id")], 20))
_RESCORED = f"""{_RANKED}, sc AS (SELECT query_id, artifact_id, count(*) AS n, max(lexical_score) AS score FROM (SELECT DISTINCT query_id, artifact_id, lexical_score FROM artifact_scores) GROUP BY 1, 2),
j AS (SELECT rk.*, sc.n, sc.score FROM rk LEFT JOIN sc USING (query_id, artifact_id)), bad AS (SELECT query_id, bool_or(coalesce(n, 0) <> 1 OR score IS NULL) AS degraded FROM j WHERE rank <= 10 GROUP BY 1)"""
put("r7_rerank_prefix", f"WITH {_RESCORED} SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 10, CASE WHEN rank <= 10 AND NOT degraded THEN score END DESC NULLS LAST, rank) AS rank, degraded FROM j JOIN bad USING (query_id)",
    lambda s, d: reranked(s, d))


def reranked(s, d):
    new = scores(s, d).select("query_id", "artifact_id", c("lexical_score").alias("score")).distinct()
    return U.reranked(ranked(s, d), new, "query_id", "artifact_id", 10)


put("r11_degraded_status", f"""WITH {_RESCORED} SELECT query_id, CASE WHEN bool_or(v) THEN 'active' ELSE 'degraded' END AS vector, CASE WHEN any_value(degraded) THEN 'degraded' ELSE 'active' END AS reranker
FROM (SELECT query_id, artifact_id, bool_or(vector_cosine IS NOT NULL) AS v FROM artifact_scores GROUP BY 1, 2) JOIN bad USING (query_id) GROUP BY 1""",
    lambda s, d: scores(s, d).groupBy("query_id").agg(F.bool_or(c("vector_cosine").isNotNull()).alias("v")).join(reranked(s, d).groupBy("query_id").agg(F.bool_or("degraded").alias("g")), "query_id").select(
        "query_id", F.when(c("v"), "active").otherwise("degraded").alias("vector"), F.when(c("g"), "degraded").otherwise("active").alias("reranker")))
put("m8_memory_query", f"""WITH {ART}, cur AS (SELECT * FROM art WHERE id NOT IN (SELECT supersedes FROM art WHERE supersedes IS NOT NULL)), sc AS (SELECT artifact_id, max(rank_score) AS score FROM artifact_scores GROUP BY 1),
rel AS (SELECT id, count(*) AS n FROM (SELECT id FROM art WHERE supersedes IS NOT NULL AND supersedes <> id UNION ALL SELECT supersedes FROM art WHERE supersedes IS NOT NULL AND supersedes <> id) GROUP BY 1),
r AS (SELECT cur.id, cur.artifact_type, coalesce(rel.n, 0) AS relations, strlen(body) AS bytes, row_number() OVER (ORDER BY score DESC, cur.id DESC) AS rank FROM cur JOIN sc ON sc.artifact_id = cur.id LEFT JOIN rel ON rel.id = cur.id WHERE score IS NOT NULL ORDER BY rank LIMIT 100)
SELECT id, artifact_type, relations, rank, sum(bytes) OVER (ORDER BY rank) <= 4000 AS detailed FROM r""",
    lambda s, d: memory_query(s, d))


def memory_query(s, d):
    """Current artifacts by their best retrieval score, each with its relations; the first are given in detail as
    long as their bodies fit the byte budget, the rest as headers."""
    best = scores(s, d).groupBy(c("artifact_id").alias("id")).agg(F.max("rank_score").alias("score")).filter("score IS NOT NULL")
    relations = links(s, d).select(c("child").alias("id")).unionByName(links(s, d).select(c("parent").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("relations"))
    rows = M.current(artifacts(s, d)).join(best, "id").join(relations, "id", "left").select("id", "artifact_type", F.coalesce("relations", F.lit(0)).alias("relations"), F.octet_length("body").alias("bytes"), "score")
    first = R.top(rows, [c("score").desc(), c("id").desc()], 100)
    return first.select("id", "artifact_type", "relations", "rank", (F.sum("bytes").over(Window.orderBy("rank")) <= 4000).alias("detailed"))


# --- evidence of memory -----------------------------------------------------------------------------------------

_SUPP = """supp AS (SELECT a.id AS artifact_id, ch.id AS chunk_id, ch.file_id, min(ch.hash) OVER (PARTITION BY a.id) AS stored_hash, min(f.repo) OVER (PARTITION BY a.id) AS stored_context, ch.hash, f.repo
  FROM art a JOIN chunks ch ON ch.name = a.name JOIN files f ON f.id = ch.file_id)"""


def supports(s, d):
    """Supports of artifacts: the chunks of the artifact's name, with what was stored of the first of them."""
    rows = artifacts(s, d).select(c("id").alias("artifact_id"), "name").join(chunks(s, d).filter("name IS NOT NULL").select(c("id").alias("chunk_id"), "file_id", "name", "hash"), "name").join(
        files(s, d).select(c("id").alias("file_id"), "repo"), "file_id")
    stored = rows.groupBy("artifact_id").agg(F.min("hash").alias("stored_hash"), F.min("repo").alias("stored_context"))
    return rows.join(stored, "artifact_id").select("artifact_id", "chunk_id", "stored_hash", "stored_context", c("hash").alias("now_hash"), c("repo").alias("now_context"))


def support_states(s, d):
    return M.stored_freshness(supports(s, d))


_STATE = "CASE WHEN hash <> stored_hash THEN 'source-stale' WHEN repo <> stored_context THEN 'context-stale' ELSE 'fresh' END"
put("m2_stored_support_freshness", f"WITH {ART}, {_SUPP} SELECT artifact_id, chunk_id, {_STATE} AS state FROM supp", support_states)
put("m3_freshness_of_supports", f"""WITH {ART}, {_SUPP}, st AS (SELECT artifact_id, {_STATE} AS state FROM supp) SELECT artifact_id, count(*) AS n, count(*) FILTER (state = 'fresh') AS n_fresh, CASE WHEN count(*) = count(*) FILTER (state = 'fresh') THEN 'fresh'
 WHEN count(*) FILTER (state = 'fresh') > 0 THEN 'degraded' ELSE 'stale' END AS freshness FROM st GROUP BY 1""", lambda s, d: M.artifact_freshness(support_states(s, d)))
put("m14_run_claims", """WITH r AS (SELECT DISTINCT artifact_type, source_snapshot, id, exported_at FROM artifact_views WHERE source_snapshot IS NOT NULL), n AS (SELECT max(exported_at) AS now FROM artifact_views),
k AS (SELECT *, row_number() OVER (PARTITION BY artifact_type, source_snapshot ORDER BY exported_at DESC, id DESC) AS n FROM r)
SELECT id, exported_at, CASE WHEN n > 1 THEN 'superseded' WHEN exported_at < now - INTERVAL 90 DAY THEN 'orphan' ELSE 'live' END AS claim FROM k, n""",
    lambda s, d: M.claims(table(s, d, "artifact_views").filter("source_snapshot IS NOT NULL").select("artifact_type", "source_snapshot", "id", "exported_at").distinct(), ["artifact_type", "source_snapshot"], table(s, d, "artifact_views").agg(F.max("exported_at").alias("now")), 90).select("id", "exported_at", "claim"))

# --- checker work -----------------------------------------------------------------------------------------------

_OWN = "own AS (SELECT c.id AS chunk_id, 'repo:' || f.repo AS project FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.repo IS NOT NULL UNION ALL SELECT c.id, 'package:' || f.package_instance_id FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.package_instance_id IS NOT NULL)"
_FAILED = "failed AS (SELECT DISTINCT 'repo:' || repo AS project FROM walk_rejections WHERE lower(trim(stage)) = 'read')"


def owned(s, d):
    return U.owners(chunks(s, d).select(c("id").alias("chunk_id"), "file_id"), files(s, d))


def failed(s, d):
    return table(s, d, "walk_rejections").filter(F.lower(F.trim("stage")) == "read").select(F.concat(F.lit("repo:"), "repo").alias("project")).distinct()


put("e4_owning_projects", f"WITH {_OWN} SELECT chunk_id, project FROM own", owned)
put("e5_execution_places", "SELECT id, row_number() OVER (ORDER BY status = 'complete', version IS NULL, id) AS place FROM package_instances",
    lambda s, d: positions(s, packages(s, d).select((c("status") == "complete").cast("int").alias("done"), c("version").isNull().cast("int").alias("inferred"), "id"), ["done", "inferred", "id"]).select("id", c("position").alias("place")))
put("e7_batch_actions", """SELECT origin, count(*) AS n, count(*) FILTER (status = 'complete') AS n_complete, CASE WHEN count(*) = count(*) FILTER (status = 'complete') THEN 'activate' WHEN count(*) FILTER (status = 'complete') > 0 THEN 'resume' ELSE 'open' END AS action FROM package_instances GROUP BY 1""",
    lambda s, d: U.batch_actions(packages(s, d), "origin", "status"))
put("e8_carried_answers", f"""WITH {_OWN}, fresh AS (SELECT 'package:' || id AS project FROM package_instances WHERE status = 'complete' UNION ALL SELECT DISTINCT 'repo:' || repo FROM files WHERE repo IS NOT NULL)
SELECT chunk_id, bool_and(project IN (SELECT project FROM fresh)) AS carried FROM own GROUP BY 1""",
    lambda s, d: U.carried(owned(s, d), packages(s, d).filter("status = 'complete'").select(F.concat(F.lit("package:"), c("id").cast("string")).alias("project")).union(files(s, d).filter("repo IS NOT NULL").select(F.concat(F.lit("repo:"), "repo")).distinct())))
put("g11_checker_facts", f"""WITH {SYM}, {REF}, {_FAILED}, fact AS (SELECT r.chunk_id || ':' || r.target_name AS occurrence, s.node_key AS target, 'repo:' || f.repo AS project, coalesce(s.role IN ('test', 'fixture'), false) AS possible FROM ref r JOIN files f ON f.id = r.file_id JOIN sym s ON s.name = r.target_name JOIN files g ON g.id = s.file_id AND g.repo = f.repo),
p AS (SELECT occurrence, target, bool_or(possible OR project IN (SELECT project FROM failed)) AS weak FROM fact GROUP BY 1, 2)
SELECT occurrence, target, CASE WHEN weak THEN 'possible' ELSE 'certain' END AS confidence, count(*) OVER (PARTITION BY occurrence) AS candidates FROM p""",
    lambda s, d: U.checker_facts(facts(s, d), failed(s, d)))


def facts(s, d):
    at = files(s, d).select(c("id").alias("file_id"), "repo")
    to = symbols(s, d).join(at, "file_id").select(c("name").alias("target_name"), "repo", c("node_key").alias("target"), F.coalesce(c("role").isin("test", "fixture"), F.lit(False)).alias("possible"))
    refs = E.references(chunks(s, d)).join(at, "file_id").join(to, ["target_name", "repo"])
    return refs.select(F.concat_ws(":", c("chunk_id").cast("string"), "target_name").alias("occurrence"), "target", F.concat(F.lit("repo:"), "repo").alias("project"), "possible")


put("z2_dirty_projects", r"""WITH dirty AS (SELECT DISTINCT repo, regexp_replace(replace(trim(path), '\', '/'), '^\./', '') AS path FROM walk_rejections) SELECT f.repo, count(*) AS n FROM files f JOIN dirty USING (repo, path) WHERE lower(trim(f.origin)) IN ('repository', 'workspace') GROUP BY 1""",
    lambda s, d: files(s, d).filter(F.lower(F.trim("origin")).isin("repository", "workspace")).join(table(s, d, "walk_rejections").select("repo", F.regexp_replace(F.translate(F.trim("path"), "\\", "/"), r"^\./", "").alias("path")).distinct(), ["repo", "path"], "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("n")))
put("z3_reusable_batches", "SELECT f.repo, bool_and(p.status = 'complete' AND p.manifest_hash IS NOT NULL) AS reusable FROM files f JOIN package_instances p ON p.id = f.package_instance_id GROUP BY 1",
    lambda s, d: files(s, d).join(packages(s, d).select(c("id").alias("package_instance_id"), "status", "manifest_hash"), "package_instance_id").groupBy("repo").agg(F.bool_and((c("status") == "complete") & c("manifest_hash").isNotNull()).alias("reusable")))
put("z4_status_transitions", "SELECT id, status, CASE WHEN status = 'complete' THEN 'complete' WHEN status = 'truncated' THEN 'pending' WHEN version IS NULL THEN 'failed' ELSE 'reset' END AS next FROM package_instances",
    lambda s, d: packages(s, d).select("id", "status", F.when(c("status") == "complete", "complete").when(c("status") == "truncated", "pending").when(c("version").isNull(), "failed").otherwise("reset").alias("next")))
put("z6_identity_recheck", "SELECT id, md5(content) = hash AS same FROM chunks", lambda s, d: chunks(s, d).select("id", (F.md5("content") == c("hash")).alias("same")))
put("z7_selected_owners", """WITH p AS (SELECT id, name, CASE status WHEN 'complete' THEN 'runtime' WHEN 'failed' THEN 'auxiliary' END AS purpose FROM package_instances), g AS (SELECT name, bool_or(coalesce(purpose <> 'auxiliary', true)) AS any_kept FROM p GROUP BY 1)
SELECT id, coalesce(purpose <> 'auxiliary', true) OR NOT any_kept AS selected, NOT any_kept AS fallback FROM p JOIN g USING (name)""",
    lambda s, d: U.selected_owners(packages(s, d).select("id", "name", F.when(c("status") == "complete", "runtime").when(c("status") == "failed", "auxiliary").alias("purpose")), "name", c("purpose")).select("id", "selected", "fallback"))
put("z8_plan_fingerprints", "SELECT repo, sum(('0x' || substr(md5(path || ':' || hash), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS fingerprint FROM files GROUP BY 1",
    lambda s, d: files(s, d).groupBy("repo").agg(U.set_digest(F.concat_ws(":", "path", "hash")).alias("fingerprint")))

# --- vectors ----------------------------------------------------------------------------------------------------

put("z9_missing_documents", "SELECT hash, min(id) AS id FROM chunks WHERE hash NOT IN (SELECT document_hash FROM semantic_embeddings WHERE document_hash IS NOT NULL) GROUP BY 1",
    lambda s, d: chunks(s, d).select("hash", "id").join(table(s, d, "semantic_embeddings").select(c("document_hash").alias("hash")), "hash", "left_anti").groupBy("hash").agg(F.min("id").alias("id")))
put("z10_selected_occurrences", "SELECT e.profile_id, count(*) AS n FROM chunks c JOIN (SELECT DISTINCT document_hash, profile_id FROM semantic_embeddings) e ON e.document_hash = c.hash GROUP BY 1",
    lambda s, d: chunks(s, d).select("hash").join(table(s, d, "semantic_embeddings").select(c("document_hash").alias("hash"), "profile_id").distinct(), "hash").groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")))
put("z11_profile_lookup", """WITH want AS (SELECT provider, model, config_fingerprint AS f FROM embedding_profiles UNION ALL SELECT provider, model, 'changed' FROM embedding_profiles)
SELECT w.provider, w.model, w.f AS wanted, coalesce(max(CASE WHEN p.config_fingerprint = w.f THEN p.id END), max(p.id)) AS id, max((p.config_fingerprint = w.f)::INT) = 1 AS exact FROM want w JOIN embedding_profiles p USING (provider, model) GROUP BY 1, 2, 3""",
    lambda s, d: (lambda p: p.select("provider", "model", c("config_fingerprint").alias("wanted")).union(p.select("provider", "model", F.lit("changed"))).join(p, ["provider", "model"]).groupBy("provider", "model", "wanted").agg(
        F.coalesce(F.max(F.when(c("config_fingerprint") == c("wanted"), c("id"))), F.max("id")).alias("id"), F.bool_or(c("config_fingerprint") == c("wanted")).alias("exact")))(table(s, d, "embedding_profiles")))
put("z13_cleared_vectors", "SELECT vec_id FROM semantic_embeddings e WHERE NOT EXISTS (SELECT 1 FROM embedding_profiles p WHERE p.id = e.profile_id AND p.provider = 'relay') GROUP BY 1",
    lambda s, d: table(s, d, "semantic_embeddings").join(table(s, d, "embedding_profiles").filter("provider = 'relay'").select(c("id").alias("profile_id")), "profile_id", "left_anti").select("vec_id").distinct())

# --- files, policies, scopes ------------------------------------------------------------------------------------

put("z14_dependency_refresh", """SELECT f.id, CASE WHEN p.status = 'failed' THEN 'changed' WHEN p.status = 'truncated' THEN 'removed' ELSE 'kept' END AS action FROM files f JOIN package_instances p ON p.id = f.package_instance_id""",
    lambda s, d: (lambda f: L.refresh_plan(f.select("id", "hash"), f.filter("status <> 'truncated'").select("id", F.when(c("status") == "failed", F.concat("hash", F.lit("'"))).otherwise(c("hash")).alias("hash")), "id", "hash"))(
        files(s, d).join(packages(s, d).select(c("id").alias("package_instance_id"), "status"), "package_instance_id")))
put("z15_projection_identity", """WITH a AS (SELECT repo, sum(('0x' || substr(md5(hash), 1, 15))::BIGINT::HUGEINT) AS x FROM files GROUP BY 1), b AS (SELECT repo, sum(('0x' || substr(md5(hash), 1, 15))::BIGINT::HUGEINT) AS y FROM files WHERE role IS NOT NULL GROUP BY 1)
SELECT a.repo, CASE WHEN x = y THEN 'skip' ELSE 'publish' END AS action FROM a LEFT JOIN b USING (repo)""",
    lambda s, d: files(s, d).groupBy("repo").agg(U.set_digest(c("hash")).alias("now"), U.set_digest(F.when(c("role").isNotNull(), c("hash"))).alias("stored")).select("repo", F.when(c("now") == c("stored"), "skip").otherwise("publish").alias("action")))
put("z16_symbol_by_anchor", f"WITH {SYM} SELECT node_key, symbol_id FROM sym",
    lambda s, d: symbols(s, d).select("node_key", U.parsed_key(c("node_key")).alias("p")).select("node_key", "p.path", "p.scope", "p.name", "p.ordinal").join(symbols(s, d).select("path", "scope", "name", "ordinal", "symbol_id"), ["path", "scope", "name", "ordinal"]).select("node_key", "symbol_id"))
_ROLE_SQL = """CASE WHEN list_has_any(parts, ['generated', '__generated__']) OR regexp_matches(fname, '\\.generated\\.|\\.gen\\.|_generated\\.|-generated\\.') OR regexp_matches(lower(substr(content, 1, 4096)), '@generated|auto-generated|autogenerated|automatically generated|this file was generated|generated file - do not edit|generated file\\. do not edit') THEN 'generated'
 WHEN list_has_any(parts, ['fixture', 'fixtures', '__fixtures__', 'mock', 'mocks', '__mocks__', 'stub', 'stubs']) OR regexp_matches(fname, '\\.(fixture|fixtures|mock|stub)\\.') THEN 'fixture'
 WHEN list_has_any(parts, ['test', 'tests', '__tests__', 'testing', 'spec', 'specs', 'e2e', 'test-utils', 'test_utils', 'integration-tests']) OR regexp_matches(fname, '\\.(test|spec|e2e|e2e-spec|integration-test)\\.') THEN 'test'
 WHEN list_has_any(parts, ['docs', 'documentation', '.storybook', 'stories']) OR regexp_matches(fname, '\\.(stories|story)\\.') THEN 'documentation' ELSE 'production' END"""
_ROLED = f"roled AS (SELECT id, repo, role, path, origin, {_ROLE_SQL} AS effective FROM (SELECT f.*, s.content, list_filter(string_split(lower(f.path), '/'), lambda x: x <> '') AS parts, list_filter(string_split(lower(f.path), '/'), lambda x: x <> '')[-1] AS fname FROM files f JOIN source_files s ON s.file_id = f.id))"


def roled(s, d):
    return files(s, d).join(sources(s, d).select(c("file_id").alias("id"), "content"), "id").withColumn("effective", S.file_role(c("path"), c("content")))


put("s7_file_role", f"WITH {_ROLED} SELECT id, effective AS role FROM roled", lambda s, d: roled(s, d).select("id", c("effective").alias("role")))
put("q18_policy_overlay", f"WITH {_ROLED} SELECT repo, coalesce(role, 'none') AS role, effective, count(*) AS n FROM roled GROUP BY 1, 2, 3", lambda s, d: roled(s, d).groupBy("repo", F.coalesce("role", F.lit("none")).alias("role"), "effective").agg(F.count(F.lit(1)).alias("n")))
put("z17_chunk_penalties", f"WITH {_ROLED} SELECT c.id, CASE r.effective WHEN 'generated' THEN 0.1 WHEN 'fixture' THEN 0.2 WHEN 'test' THEN 0.3 WHEN 'documentation' THEN 0.4 ELSE 1.0 END::DOUBLE AS penalty FROM chunks c JOIN roled r ON r.id = c.file_id",
    lambda s, d: chunks(s, d).select("id", "file_id").join(roled(s, d).select(c("id").alias("file_id"), "effective"), "file_id").select("id", X.role_penalty(c("effective")).alias("penalty")))
put("z18_deepest_subject", """WITH sub AS (SELECT DISTINCT regexp_replace(path, '/[^/]+$', '') AS key FROM files WHERE role IN ('test', 'fixture')) SELECT f.id, arg_max(sub.key, length(sub.key)) AS subject FROM files f JOIN sub ON starts_with(f.path, sub.key || '/') GROUP BY 1""",
    lambda s, d: (lambda f: I.longest_prefix(f, f.filter(c("role").isin("test", "fixture")).select(F.regexp_replace("path", "/[^/]+$", "").alias("root")).distinct(), "path", "id", "root", "root").select("id", c("root").alias("subject")))(files(s, d)))
put("z22_scope_attachment", f"WITH {_ROLED} SELECT id, coalesce(CASE WHEN effective <> 'production' THEN 'policy:' || effective END, 'repo:' || nullif(repo, ''), 'structural:' || coalesce(lower(trim(origin)), 'repository') || ':' || string_split(path, '/')[1]) AS scope FROM roled",
    lambda s, d: roled(s, d).select("id", F.coalesce(F.when(c("effective") != "production", F.concat(F.lit("policy:"), "effective")), F.concat(F.lit("repo:"), F.when(c("repo") != "", c("repo"))),
        F.concat(F.lit("structural:"), F.coalesce(F.lower(F.trim("origin")), F.lit("repository")), F.lit(":"), F.element_at(F.split("path", "/"), 1))).alias("scope")))
put("z23_targeted_subjects", BASE + """, w AS (SELECT dst_key AS key, sum(CASE confidence WHEN 'certain' THEN 1.0 WHEN 'likely' THEN 0.6 ELSE 0.3 END) AS weight FROM edges GROUP BY 1)
SELECT key, round(weight, 6)::DOUBLE AS weight, kind FROM (SELECT node_key AS key, 'anchor' AS kind FROM sym WHERE exported UNION SELECT 'file:' || path, 'file' FROM files WHERE role = 'production') JOIN w USING (key)""",
    lambda s, d: symbols(s, d).filter("exported").select(c("node_key").alias("key"), F.lit("anchor").alias("kind")).union(files(s, d).filter("role = 'production'").select(F.concat(F.lit("file:"), "path"), F.lit("file"))).join(
        edges(s, d).groupBy(c("dst_key").alias("key")).agg(F.round(F.sum(X.confidence_weight(c("confidence"))), 6).alias("weight")), "key").select("key", "weight", "kind"))
put("z25_latest_classification", "SELECT path, arg_max(id, (logged_at, id)) AS entry FROM (SELECT path, logged_at, row_number() OVER (ORDER BY path, logged_at, stage, error, repo) AS id FROM (SELECT DISTINCT * FROM walk_rejections)) GROUP BY 1",
    lambda s, d: (lambda r: positions(s, r, ["path", "logged_at", "stage", "error", "repo"], [c(x).asc_nulls_last() for x in ("path", "logged_at", "stage", "error", "repo")]))(table(s, d, "walk_rejections").distinct()).groupBy("path").agg(
        F.max(F.struct("logged_at", "position")).alias("b")).select("path", c("b.position").alias("entry")))
put("z28_workspace_packages", "SELECT array_to_string(string_split(path, '/')[1:2], '/') AS root, count(*) AS n FROM files WHERE path LIKE 'packages/%' GROUP BY 1",
    lambda s, d: files(s, d).filter(c("path").startswith("packages/")).groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("root")).agg(F.count(F.lit(1)).alias("n")))
put("z29_excerpt_drift", "SELECT c.id, NOT contains(s.content, c.content) AS drifted FROM chunks c JOIN source_files s USING (file_id) WHERE c.content IS NOT NULL AND s.content IS NOT NULL",
    lambda s, d: chunks(s, d).filter("content IS NOT NULL").select("id", "file_id", c("content").alias("part")).join(sources(s, d).filter("content IS NOT NULL"), "file_id").select("id", (~c("content").contains(c("part"))).alias("drifted")))

# --- artifacts --------------------------------------------------------------------------------------------------

put("z21_publication_guards", f"""WITH {ART}, kids AS (SELECT supersedes AS id, count(*) AS n FROM art WHERE supersedes IS NOT NULL AND supersedes <> id GROUP BY 1)
SELECT a.id, a.is_current IS NOT DISTINCT FROM (kids.n IS NULL) AND a.freshness IS NOT DISTINCT FROM 'fresh' AS publishable FROM art a LEFT JOIN kids ON kids.id = a.id""",
    lambda s, d: artifacts(s, d).select("id", "is_current", "freshness").join(links(s, d).groupBy(c("parent").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select(
        "id", (c("is_current").eqNullSafe(c("n").isNull()) & c("freshness").eqNullSafe(F.lit("fresh"))).alias("publishable")))
put("z24_children_by_prefix", f"WITH {ART} SELECT a.id, count(b.id) AS n FROM art a JOIN art b ON b.artifact_type = a.artifact_type AND starts_with(b.name, a.name) AND b.id <> a.id WHERE b.id NOT IN (SELECT supersedes FROM art WHERE supersedes IS NOT NULL) GROUP BY 1",
    lambda s, d: children_by_prefix(s, d))


def children_by_prefix(s, d):
    """How many current artifacts of its type have a name that begins with an artifact's: every prefix of a name is
    joined by equality, no name is compared with all."""
    now = M.current(artifacts(s, d)).select(c("id").alias("k"), "artifact_type", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(c("name"), F.lit(1), n))).alias("name"))
    return artifacts(s, d).select("id", "artifact_type", "name").join(now, ["artifact_type", "name"]).filter("k <> id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


put("z26_hydrated_candidates", f"WITH {SYM} SELECT s.symbol_id, s.line, s.line + length(c.content) - length(replace(c.content, chr(10), '')) - suffix(c.content, chr(10))::INT AS end_line FROM sym s JOIN chunks c ON c.id = s.symbol_id",
    lambda s, d: symbols(s, d).select("symbol_id", "line").join(chunks(s, d).select(c("id").alias("symbol_id"), "content"), "symbol_id").select(
        "symbol_id", "line", (c("line") + F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) - c("content").endswith("\n").cast("int")).alias("end_line")))
_RANKC = "CASE confidence WHEN 'possible' THEN 1 WHEN 'likely' THEN 2 WHEN 'certain' THEN 3 ELSE 0 END"
put("z27_relation_contract", f"""WITH {ART}, lk AS (SELECT DISTINCT supersedes AS parent, id AS child FROM art WHERE supersedes IS NOT NULL AND supersedes <> id), r AS (SELECT id, {_RANKC} AS rank FROM art)
SELECT parent, child, CASE WHEN p.rank IS NULL OR k.rank IS NULL THEN 'missing' ELSE 'less sure' END AS reason FROM lk LEFT JOIN r p ON p.id = parent LEFT JOIN r k ON k.id = child WHERE p.rank IS NULL OR k.rank IS NULL OR k.rank < p.rank""",
    lambda s, d: U.contract_violations(links(s, d), artifacts(s, d)))
put("z33_paired_report", """WITH b AS (SELECT query_id, artifact_id, max(lexical_score) AS cold, max(vector_cosine) AS warm FROM artifact_scores GROUP BY 1, 2) SELECT query_id, count(*) FILTER (cold IS NOT NULL AND warm IS NOT NULL) AS pairs, round(avg(warm - cold), 6) AS mean_difference FROM b GROUP BY 1""",
    lambda s, d: scores(s, d).groupBy("query_id", "artifact_id").agg(F.max("lexical_score").alias("cold"), F.max("vector_cosine").alias("warm")).groupBy("query_id").agg(
        F.count_if(c("cold").isNotNull() & c("warm").isNotNull()).alias("pairs"), F.round(F.avg(c("warm") - c("cold")), 6).alias("mean_difference")))

# --- entities and rendering -------------------------------------------------------------------------------------

put("q16_entities", f"""WITH {SITE}, e AS (SELECT plane, entity_type, name, sum(n)::BIGINT AS occurrences FROM site GROUP BY 1, 2, 3 HAVING contains(lower(name), 'er'))
SELECT plane, entity_type, name, occurrences, matched, rank FROM (SELECT *, count(*) OVER () AS matched, row_number() OVER (ORDER BY name = 'er' DESC, occurrences DESC, plane, entity_type, name) AS rank FROM e) WHERE rank <= 20""",
    lambda s, d: entity_lookup(s, d))


def entity_lookup(s, d):
    found = sites(s, d).filter(F.lower("name").contains("er")).groupBy("plane", "entity_type", "name").agg(F.sum("n").alias("occurrences"))
    first = R.top(found, [(c("name") == "er").desc(), c("occurrences").desc(), c("plane"), c("entity_type"), c("name")], 20)
    return first.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("matched"))))  # one row


put("q17_overview_inventory", BASE + f""", {SITE} SELECT 'relation' AS section, kind AS key, count(*) AS n FROM edges GROUP BY 2 UNION ALL SELECT 'entity', entity_type, count(DISTINCT (plane, entity_type, name)) FROM site GROUP BY 2
UNION ALL SELECT 'area', string_split(path, '/')[1], count(*) FROM files GROUP BY 2""",
    lambda s, d: edges(s, d).groupBy(c("kind").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("section"), "key", "n").unionByName(
        sites(s, d).select("plane", "entity_type", "name").distinct().groupBy(c("entity_type").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("section"), "key", "n")).unionByName(
        files(s, d).groupBy(F.element_at(F.split("path", "/"), 1).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("area").alias("section"), "key", "n")))
put("z1_declaration_spans", f"WITH {SYM} SELECT symbol_id, decl_start AS span_start, decl_end AS span_end FROM sym WHERE decl_start IS NOT NULL AND decl_end IS NOT NULL",
    lambda s, d: symbols(s, d).select("symbol_id", F.to_json(F.struct(F.struct(c("decl_start").alias("start"), c("decl_end").alias("end")).alias("declaration"))).alias("meta")).select(
        "symbol_id", F.get_json_object("meta", "$.declaration.start").cast("long").alias("span_start"), F.get_json_object("meta", "$.declaration.end").cast("long").alias("span_end")).filter("span_start IS NOT NULL AND span_end IS NOT NULL"))


def rendered(s, d):
    """The edges among the twenty nodes of greatest degree, compact."""
    top = degrees(s, d).orderBy(c("degree").desc(), "node").limit(20).select("node")
    inner = edges(s, d).join(F.broadcast(top.select(c("node").alias("src_key"))), "src_key", "left_semi").join(F.broadcast(top.select(c("node").alias("dst_key"))), "dst_key", "left_semi")
    return U.compact_graph(inner)


put("z34_compact_graph", None, rendered)

# --- watch ------------------------------------------------------------------------------------------------------

_GEN = """g AS (SELECT user_id, generation, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS generation FROM (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 36000000000 THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY 1, 2),
sup AS (SELECT user_id, generation::BIGINT AS generation, coalesce(epoch_us(lead(first_ts) OVER (PARTITION BY user_id ORDER BY generation)) < epoch_us(last_ts) + 72000000000, false) AS superseded FROM g)"""


def generations(s, d):
    per = L.generations(table(s, d, "events").select("user_id", "ts"), "user_id", "ts", 36_000).groupBy("user_id", "generation").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return U.superseded(per, "user_id", 72_000).select("user_id", c("generation").cast("long").alias("generation"), "superseded")


put("l4_superseded_generations", f"WITH {_GEN} SELECT * FROM sup", generations)
put("l6_phase_chain", f"WITH {_GEN} SELECT user_id, generation, superseded, step, phase FROM sup, (VALUES (0, 'refresh'), (1, 'embed'), (2, 'enrich'), (3, 'semantic-embed')) p(step, phase) WHERE NOT superseded OR step = 0", lambda s, d: U.phases(generations(s, d)))
put("l7_retry_delays", "SELECT n_nationkey AS attempt, least(30.0, 0.5 * pow(2, n_nationkey))::DOUBLE AS delay FROM nation", lambda s, d: table(s, d, "nation").select(c("n_nationkey").alias("attempt"), U.retry_delay(c("n_nationkey")).alias("delay")))
put("l8_drift_flush_due", "SELECT user_id, max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) AS due FROM events GROUP BY 1",
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(table(s, d, "events").agg(F.max("ts").alias("now")))).select("user_id", (c("last") + F.expr("INTERVAL 24 HOURS") <= c("now")).alias("due")))
put("l11_version_invalidation", """WITH v AS (SELECT id, version IS DISTINCT FROM max(version) OVER (PARTITION BY name) AS old FROM package_instances) SELECT f.id, CASE WHEN v.old IS NOT TRUE THEN f.hash END AS hash FROM files f LEFT JOIN v ON v.id = f.package_instance_id""",
    lambda s, d: files(s, d).select("id", "hash", "package_instance_id").join(packages(s, d).select(c("id").alias("package_instance_id"), (~c("version").eqNullSafe(F.max("version").over(Window.partitionBy("name")))).alias("old")), "package_instance_id", "left").select(
        "id", F.when(~F.coalesce("old", F.lit(False)), c("hash")).alias("hash")))
put("s5_line_index", """SELECT c.id AS chunk_id, c.file_id, length(decode(encode(s.content)[1:least(c.start_byte, strlen(s.content))])) - length(replace(decode(encode(s.content)[1:least(c.start_byte, strlen(s.content))]), chr(10), '')) + 1 AS line FROM chunks c JOIN source_files s USING (file_id) WHERE c.start_byte IS NOT NULL AND s.content IS NOT NULL""",
    lambda s, d: S.lines_of(chunks(s, d).select(c("id").alias("chunk_id"), "file_id", "start_byte"), sources(s, d), "chunk_id", "file_id", "start_byte"))
put("s11_dependency_scan", None, lambda s, d: T.greedy_budget(
    files(s, d).filter(F.lower(F.trim("origin")) == "dependency").select("id", "repo", c("path").contains("index").alias("forced")).join(sources(s, d).select(c("file_id").alias("id"), F.octet_length("content").cast("long").alias("n_bytes")), "id"),
    "repo", ["id"], "n_bytes", T.SCAN_BYTES, "forced", T.SCAN_FILES, T.SCAN_EACH).select("id", "taken"))


# --- anchors, comments, workspaces ------------------------------------------------------------------------------


def wanted_anchors(s, d):
    """Names, file names, keys and path:name pairs of everything indexed, and one that names nothing."""
    sym = symbols(s, d)
    parts = [sym.select(c("name").alias("anchor")), sym.select("node_key"), sym.select(F.concat("path", F.lit(":"), "name")), files(s, d).select(F.element_at(F.split("path", "/"), -1)), files(s, d).select(F.concat(F.lit("file:"), "path"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.union(s.createDataFrame([("no such anchor",)], "anchor string"))


put("q1_resolved_anchors", f"""WITH {SYM}, want AS (SELECT name AS anchor FROM sym UNION SELECT node_key FROM sym UNION SELECT path || ':' || name FROM sym UNION SELECT string_split(path, '/')[-1] FROM files UNION SELECT 'file:' || path FROM files UNION SELECT 'no such anchor'),
hit AS (SELECT w.anchor, 1 AS tier, s.node_key FROM want w JOIN sym s ON s.node_key = w.anchor UNION ALL SELECT w.anchor, 2, 'file:' || f.path FROM want w JOIN files f ON 'file:' || f.path = w.anchor
  UNION ALL SELECT w.anchor, 3, 'file:' || f.path FROM want w JOIN files f ON f.path = w.anchor OR suffix(f.path, '/' || w.anchor) UNION ALL SELECT w.anchor, 4, s.node_key FROM want w JOIN sym s ON s.path || ':' || s.name = w.anchor
  UNION ALL SELECT w.anchor, 5, s.node_key FROM want w JOIN sym s ON s.name = w.anchor),
t AS (SELECT anchor, min(tier) AS tier FROM hit GROUP BY 1), k AS (SELECT anchor, tier, count(*) AS n, min(node_key) AS k FROM hit JOIN t USING (anchor, tier) GROUP BY 1, 2)
SELECT w.anchor, k.tier, coalesce(k.n, 0) AS n_candidates, CASE WHEN k.n = 1 THEN k.k END AS node_key FROM want w LEFT JOIN k USING (anchor)""",
    lambda s, d: Q.resolved_anchors(wanted_anchors(s, d), symbols(s, d), files(s, d)))
put("s6_comment_spans", None, lambda s, d: S.leading_comment_starts(chunks(s, d).select(c("id").alias("chunk_id"), "file_id", "start_byte"), sources(s, d), "chunk_id", "file_id", "start_byte"))


def manifests(s, d):
    """A manifest for every top folder, as the tables hold no package.json."""
    roots = files(s, d).select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("root")).distinct()
    return roots.select(F.concat("root", F.lit("/package.json")).alias("path"), F.to_json(F.struct(F.concat(F.lit("@kit/"), F.element_at(F.split("root", "/"), -1)).alias("name"))).alias("text"))


put("s13_workspace_packages", """WITH r AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS root FROM files) SELECT min(root) AS root, '@kit/' || string_split(root, '/')[-1] AS name, 'src/index.ts' AS entry FROM r WHERE regexp_matches(root, '^packages/[^/]+$') GROUP BY 2""",
    lambda s, d: S.workspaces(manifests(s, d), ["packages/*"]))
