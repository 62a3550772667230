"""Memory, policy, planning, enrichment, metrics and incremental refresh over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import evidence as E
from ..operators import hierarchy as H
from ..operators import memory as M
from ..operators import metrics as A
from ..operators import policy as P
from ..operators import retrieval as R
from ..session import table
from ..streaming import watch as L
from .graph import BASE, IMP, MEM, REF, SYM, edges, imports, symbols
from .registry import Registry
from .scalars import AREA_SQL

REG = Registry()
c = F.col


def put(name, sql, f):
    REG.add(name, sql)(f)


_COLS = ["supersedes", "superseded_by", "artifact_type", "name", "is_current", "body", "confidence", "freshness", "support_count", "exported_at"]


def artifacts(s: SparkSession, d: str) -> DataFrame:
    """The newest export of each artifact."""
    return H.latest(table(s, d, "artifact_views"), "id", ["exported_at", "created_at", "supersedes", "superseded_by"], _COLS)


ART = """art AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exported_at DESC NULLS LAST, created_at DESC NULLS LAST, supersedes DESC NULLS LAST, superseded_by DESC NULLS LAST) AS rn
  FROM artifact_views WHERE id IS NOT NULL) WHERE rn = 1)"""
SUP = "sup AS (SELECT DISTINCT query_id AS artifact_id, artifact_id AS evidence_id FROM artifact_scores)"


def supports(s, d):
    return table(s, d, "artifact_scores").select(c("query_id").alias("artifact_id"), c("artifact_id").alias("evidence_id")).distinct()


def links(s, d):
    return artifacts(s, d).filter("supersedes IS NOT NULL AND supersedes <> id").select(c("id").alias("child"), c("supersedes").alias("parent"))


# --- memory -----------------------------------------------------------------------------------------------------

put("m1_j13_current_view", f"WITH {ART} SELECT id FROM art WHERE id NOT IN (SELECT supersedes FROM art WHERE supersedes IS NOT NULL)", lambda s, d: M.current(artifacts(s, d)).select("id"))
put("m4_a20_hierarchical_freshness", f"""WITH RECURSIVE {ART}, lnk AS (SELECT DISTINCT id AS child, supersedes AS parent FROM art WHERE supersedes IS NOT NULL AND supersedes <> id),
bad AS (SELECT id, 0 AS hops FROM art WHERE freshness IN ('degraded', 'stale') UNION SELECT lnk.parent, bad.hops + 1 FROM bad JOIN lnk ON lnk.child = bad.id WHERE bad.hops < 8)
SELECT id, CASE WHEN freshness = 'stale' THEN 'stale' WHEN id IN (SELECT id FROM bad) THEN 'degraded' ELSE 'fresh' END AS freshness FROM art""",
    lambda s, d: M.hierarchical_freshness(s, artifacts(s, d), links(s, d)))
put("m5_child_set_completeness", f"WITH {ART} SELECT a.id, count(k.id) = a.support_count AS complete FROM art a LEFT JOIN art k ON k.supersedes = a.id AND k.id <> a.id WHERE a.support_count IS NOT NULL GROUP BY a.id, a.support_count",
    lambda s, d: (lambda a, l: a.filter("support_count IS NOT NULL").join(l.groupBy(c("parent").alias("_p")).agg(F.count(F.lit(1)).alias("k")), c("id") == c("_p"), "left").select(
        "id", (F.coalesce("k", F.lit(0)) == c("support_count")).alias("complete")))(artifacts(s, d), links(s, d)))
_ASK = "routes the shard of each window"
_REL = f"""rel AS (SELECT id, name, least(1.0, (len(list_intersect(list_distinct(list_filter(list_transform(regexp_extract_all('{_ASK}', '[A-Za-z0-9_$]+'), lambda t: lower(t)), lambda t: strlen(t) > 1)),
  list_filter(list_transform(regexp_extract_all(concat_ws(' ', name, body), '[A-Za-z0-9_$]+'), lambda t: lower(t)), lambda t: strlen(t) > 1))) + CASE WHEN lower(name) = '{_ASK}' THEN 4 ELSE 0 END) / 6) AS relevance FROM art)"""


def lexical(s, d):
    return artifacts(s, d).select("id", F.round(X.lexical_relevance(F.lit(_ASK), c("name"), c("body")), 6).alias("relevance")).filter("relevance IS NOT NULL")


def ranked_artifacts(s: SparkSession, d: str) -> DataFrame:
    words = R.top(lexical(s, d), [c("relevance").desc(), c("id").desc()], 100)
    cos = table(s, d, "artifact_scores").groupBy(c("artifact_id").alias("id")).agg(F.max("vector_cosine").alias("cosine")).filter("cosine IS NOT NULL")
    near = R.top(cos, [c("cosine").desc(), c("id").desc()], 100)
    return R.max_normalized(R.reciprocal_rank_fusion([words, near], "id", 100), "score")


put("m6_artifact_ranking", f"""WITH {ART}, {_REL}, w AS (SELECT id, row_number() OVER (ORDER BY round(relevance, 6) DESC, id DESC) AS rank FROM rel WHERE relevance > 0 ORDER BY rank LIMIT 100),
v AS (SELECT id, row_number() OVER (ORDER BY cosine DESC, id DESC) AS rank FROM (SELECT artifact_id AS id, max(vector_cosine) AS cosine FROM artifact_scores GROUP BY 1) WHERE cosine IS NOT NULL ORDER BY rank LIMIT 100),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM v) GROUP BY 1),
t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f ORDER BY rank LIMIT 100)
SELECT id, round(score / (SELECT max(score) FROM t), 6) AS score, rank FROM t""", ranked_artifacts)
put("m7_localised_memory", f"""WITH {ART}, {SUP}, t AS (SELECT a.id, min(CASE WHEN s.artifact_id = 1 THEN 0 WHEN s.artifact_id IS NOT NULL THEN 1 ELSE 2 END) AS tier FROM art a LEFT JOIN sup s ON s.evidence_id = a.id GROUP BY 1)
SELECT id, tier::BIGINT AS tier, row_number() OVER (ORDER BY tier, id DESC) AS rank FROM t ORDER BY rank LIMIT 100""",
    lambda s, d: R.top(artifacts(s, d).select("id").join(supports(s, d).select(c("evidence_id").alias("_e"), "artifact_id"), c("id") == c("_e"), "left").groupBy("id").agg(
        F.min(F.when(c("artifact_id") == 1, 0).when(c("artifact_id").isNotNull(), 1).otherwise(2)).cast("long").alias("tier")), [c("tier"), c("id").desc()], 100))
put("m9_related_artifacts", f"WITH {ART}, lnk AS (SELECT id AS child, supersedes AS parent FROM art WHERE supersedes IS NOT NULL AND supersedes <> id) SELECT parent AS id, child AS other, 'child' AS side FROM lnk UNION ALL SELECT child, parent, 'parent' FROM lnk",
    lambda s, d: M.related(links(s, d)))
put("m10_evidence_paths", f"""WITH RECURSIVE {ART}, lnk AS (SELECT DISTINCT id AS child, supersedes AS parent FROM art WHERE supersedes IS NOT NULL AND supersedes <> id),
down AS (SELECT id AS root, id AS node, [id] AS p, 0 AS hops FROM art WHERE supersedes IS NULL
UNION ALL SELECT down.root, lnk.child, list_append(down.p, lnk.child), down.hops + 1 FROM down JOIN lnk ON lnk.parent = down.node WHERE down.hops < 8 AND NOT list_contains(down.p, lnk.child))
SELECT root, array_to_string(p, '>') AS path, hops::BIGINT AS hops FROM down WHERE hops > 0""",
    lambda s, d: M.evidence_paths(s, links(s, d), artifacts(s, d).filter("supersedes IS NULL")))
put("m11_concept_tags", "SELECT DISTINCT a.id AS concept, b.id AS chunk_id FROM chunks a JOIN chunks b ON a.file_id = b.file_id AND a.start_line <= b.end_line + 5 AND a.end_line + 5 >= b.start_line WHERE a.id <> b.id",
    lambda s, d: (lambda k: k.select(c("id").alias("concept"), c("file_id").alias("f"), c("start_line").alias("s1"), c("end_line").alias("e1")).join(
        k.select(c("id").alias("chunk_id"), "file_id", "start_line", "end_line"), (c("f") == c("file_id")) & (c("s1") <= c("end_line") + 5) & (c("e1") + 5 >= c("start_line"))).filter("concept <> chunk_id").select("concept", "chunk_id").distinct())(table(s, d, "chunks")))
put("m12_memory_attachment", f"""WITH {ART}, {SUP}, hot AS (SELECT evidence_id AS id FROM sup WHERE artifact_id = 1), lnk AS (SELECT id AS child, supersedes AS parent FROM art WHERE supersedes IS NOT NULL AND supersedes <> id),
n AS (SELECT id, 0 AS tier FROM hot UNION ALL SELECT parent, 1 FROM lnk WHERE child IN (SELECT id FROM hot) UNION ALL SELECT child, 1 FROM lnk WHERE parent IN (SELECT id FROM hot))
SELECT id, min(tier)::BIGINT AS tier FROM n GROUP BY 1""",
    lambda s, d: (lambda hot: hot.select("id", F.lit(0).cast("long").alias("tier")).unionByName(M.related(links(s, d)).join(hot, "id", "left_semi").select(c("other").alias("id"), F.lit(1).cast("long").alias("tier"))).groupBy("id").agg(F.min("tier").alias("tier")))(
        supports(s, d).filter("artifact_id = 1").select(c("evidence_id").alias("id"))))
put("m13_validated_append", """SELECT w.path, CASE WHEN f.path IS NULL THEN 'unknown path' WHEN w.error IS DISTINCT FROM f.hash THEN 'changed source' ELSE NULL END AS reason FROM (SELECT DISTINCT path, error FROM walk_rejections) w LEFT JOIN files f ON f.path = w.path""",
    lambda s, d: (lambda a, r: r.select("path", "reason").unionByName(a.select("path", F.lit(None).cast("string").alias("reason"))))(*M.validated_append(
        table(s, d, "artifact_views").select("id"), table(s, d, "walk_rejections").select(F.lit(-1).cast("long").alias("id"), c("error").alias("hash"), "path").distinct(), table(s, d, "files"))))
put("m15_refresh_selection", f"WITH {ART} SELECT id FROM art WHERE freshness IN ('degraded', 'stale') AND id NOT IN (SELECT supersedes FROM art WHERE supersedes IS NOT NULL)",
    lambda s, d: M.current(artifacts(s, d)).filter(M.freshness_rank(c("freshness")) > 0).select("id"))

# --- policy and planning ----------------------------------------------------------------------------------------

put("p_scopes", f"SELECT scope, count(*) AS n_files, count(DISTINCT role) AS n_roles, (CASE WHEN scope LIKE 'packages/%' THEN 0 ELSE 1 END)::BIGINT AS priority FROM (SELECT {AREA_SQL} AS scope, role FROM files) GROUP BY 1",
    lambda s, d: P.scopes(table(s, d, "files")))
put("p_subdivision", "SELECT CASE WHEN contains(r, '/') THEN string_split(r, '/')[1] ELSE '.' END AS child, count(*) AS n_files FROM (SELECT substr(path, length('packages/core/') + 1) AS r FROM files WHERE path LIKE 'packages/core/%') GROUP BY 1",
    lambda s, d: P.subdivided(table(s, d, "files"), "packages/core"))
put("p_evidence_fingerprint", """WITH l AS (SELECT repo, path, hash, row_number() OVER (PARTITION BY repo ORDER BY path, hash) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n FROM files),
m AS (SELECT *, i IN (SELECT k * (n - 1) // 7 FROM range(8) t(k)) AS member FROM l)
SELECT repo, sha256(sha256(count(*) || ':' || sum(('0x' || substr(sha256(path), 1, 12))::BIGINT)::VARCHAR) || ':' || string_agg(CASE WHEN member THEN hash END, ',' ORDER BY i)) AS fingerprint FROM m GROUP BY 1""",
    lambda s, d: P.evidence_fingerprint(s, table(s, d, "files")))
put("p_policy_reconcile", """WITH k AS (SELECT id, regexp_replace(path, '/[^/]+$', '') AS subject, role, CASE WHEN role IN ('test', 'fixture') THEN 'certain' ELSE 'possible' END AS confidence FROM files WHERE role IS NOT NULL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id DESC) AS rn FROM k) WHERE rn = 1)
SELECT subject, id, role, confidence FROM n WHERE NOT EXISTS (SELECT 1 FROM n u WHERE u.confidence = 'certain' AND starts_with(n.subject, u.subject || '/'))""",
    lambda s, d: P.reconciled(table(s, d, "files").filter("role IS NOT NULL").select("id", F.regexp_replace("path", "/[^/]+$", "").alias("subject"), "role",
        F.when(c("role").isin("test", "fixture"), "certain").otherwise("possible").alias("confidence"), F.lit(True).alias("valid"))))
put("p_seeds", BASE + " SELECT node_key FROM sym WHERE exported AND role IN ('production', 'unknown') AND node_key NOT IN (SELECT dst_key FROM edges WHERE kind IN ('call', 'name_candidate'))",
    lambda s, d: symbols(s, d).filter(c("exported") & c("role").isin("production", "unknown")).select("node_key").join(edges(s, d).filter("kind IN ('call', 'name_candidate')").select(c("dst_key").alias("node_key")), "node_key", "left_anti"))
put("p_card_subjects", BASE + """, w AS (SELECT s.node_key, s.path, coalesce(sum(CASE e.confidence WHEN 'certain' THEN 1.0 WHEN 'likely' THEN 0.6 WHEN 'possible' THEN 0.3 END), 0)::DOUBLE AS weight FROM sym s LEFT JOIN edges e ON e.dst_key = s.node_key WHERE s.exported GROUP BY 1, 2)
SELECT node_key, round(weight, 6) AS weight, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY round(weight, 6) DESC, node_key) AS depth FROM w""",
    lambda s, d: symbols(s, d).filter("exported").select("node_key", "path").join(edges(s, d).groupBy(c("dst_key").alias("node_key")).agg(F.sum(X.confidence_weight(c("confidence"))).alias("w")), "node_key", "left").select(
        "node_key", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("weight"), F.split_part("path", F.lit("/"), F.lit(2)).alias("a")).withColumn(
        "depth", F.row_number().over(Window.partitionBy("a").orderBy(c("weight").desc(), "node_key")).cast("long")).drop("a"))
put("p_plan_dedup", "SELECT hs, min(file_id) AS file_id, count(*) AS n FROM (SELECT file_id, sha256(string_agg(hash, ',' ORDER BY hash)) AS hs FROM (SELECT DISTINCT file_id, hash FROM chunks) GROUP BY 1) GROUP BY 1",
    lambda s, d: table(s, d, "chunks").groupBy("file_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("hash")), ","), 256).alias("hs")).groupBy("hs").agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n")))
put("p_concept_groups", f"""WITH {ART} SELECT lower(name) AS concept, count(*) AS n, CASE WHEN count(*) > 64 THEN 'too many children' WHEN bool_or(freshness IN ('degraded', 'stale')) THEN 'not fresh' WHEN sum(support_count) > 160 THEN 'too many supports' END AS refusal FROM art WHERE name IS NOT NULL GROUP BY 1""",
    lambda s, d: artifacts(s, d).filter("name IS NOT NULL").groupBy(F.lower("name").alias("concept")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(M.freshness_rank(c("freshness")) > 0).alias("b"), F.sum("support_count").alias("k")).select(
        "concept", "n", F.when(c("n") > 64, "too many children").when(c("b"), "not fresh").when(c("k") > 160, "too many supports").alias("refusal")))
put("p_summary_scopes", f"SELECT area, count(*) AS n_files, bool_and(has) AS complete FROM (SELECT f.id, {AREA_SQL} AS area, EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = f.id) AS has FROM files f) GROUP BY 1",
    lambda s, d: table(s, d, "files").select("id", X.repository_area(c("path")).alias("area")).join(table(s, d, "chunks").select(c("file_id").alias("id")).distinct().withColumn("has", F.lit(True)), "id", "left").groupBy("area").agg(
        F.count(F.lit(1)).alias("n_files"), F.bool_and(F.coalesce("has", F.lit(False))).alias("complete")))

# --- enrichment -------------------------------------------------------------------------------------------------

put("e1_occurrence_flags", f"""WITH {SYM}, {REF}, {MEM}, {IMP} SELECT r.chunk_id, r.target_name, EXISTS (SELECT 1 FROM sym s WHERE s.file_id = r.file_id AND s.name = r.target_name) AS local,
EXISTS (SELECT 1 FROM imp i WHERE i.file_id = r.file_id AND i.local_name = r.target_name) AS imported, EXISTS (SELECT 1 FROM sym s WHERE s.name = r.target_name AND s.role = 'production') AS namesake,
EXISTS (SELECT 1 FROM mem m WHERE m.chunk_id = r.chunk_id AND m.prop = r.target_name) AS member FROM ref r""",
    lambda s, d: (lambda r, sy, i, m: r.join(sy.select("file_id", c("name").alias("target_name")).distinct().withColumn("l", F.lit(True)), ["file_id", "target_name"], "left").join(
        i.select("file_id", c("local_name").alias("target_name")).distinct().withColumn("i", F.lit(True)), ["file_id", "target_name"], "left").join(
        sy.filter("role = 'production'").select(c("name").alias("target_name")).distinct().withColumn("k", F.lit(True)), "target_name", "left").join(
        m.select("chunk_id", c("prop").alias("target_name")).distinct().withColumn("m", F.lit(True)), ["chunk_id", "target_name"], "left").select(
        "chunk_id", "target_name", F.coalesce("l", F.lit(False)).alias("local"), F.coalesce("i", F.lit(False)).alias("imported"), F.coalesce("k", F.lit(False)).alias("namesake"), F.coalesce("m", F.lit(False)).alias("member")))(
        E.references(table(s, d, "chunks")), symbols(s, d), imports(s, d), E.member_calls(table(s, d, "chunks"))))
put("e2_eligibility_counters", f"""WITH {SYM}, {REF} SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM sym s WHERE s.file_id = r.file_id AND s.name = r.target_name)) AS resolved,
count(*) FILTER (f.role IN ('test', 'fixture')) AS excluded FROM ref r JOIN files f ON f.id = r.file_id""",
    lambda s, d: (lambda r, sy: r.join(table(s, d, "files").select(c("id").alias("file_id"), "role"), "file_id").join(sy.select("file_id", c("name").alias("target_name")).distinct().withColumn("l", F.lit(True)), ["file_id", "target_name"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("l")).alias("resolved"), F.count_if(c("role").isin("test", "fixture")).alias("excluded")))(E.references(table(s, d, "chunks")), symbols(s, d)))
put("e3_inferred_gate", "SELECT repo FROM files GROUP BY 1 HAVING NOT bool_and(coalesce(role, 'unknown') = 'unknown')",
    lambda s, d: table(s, d, "files").groupBy("repo").agg(F.bool_and(F.coalesce("role", F.lit("unknown")) == "unknown").alias("a")).filter("NOT a").select("repo"))
put("e6_answer_mapping", f"""WITH {SYM}, {REF} SELECT r.target_name, count(DISTINCT s.node_key) AS n_targets, CASE WHEN count(DISTINCT s.node_key) BETWEEN 1 AND 3 THEN 'likely' ELSE 'possible' END AS confidence FROM ref r LEFT JOIN sym s ON s.name = r.target_name GROUP BY 1""",
    lambda s, d: E.references(table(s, d, "chunks")).select("target_name").distinct().join(symbols(s, d).select(c("name").alias("target_name"), "node_key"), "target_name", "left").groupBy("target_name").agg(
        F.count_distinct("node_key").alias("n_targets")).withColumn("confidence", F.when(c("n_targets").between(1, 3), "likely").otherwise("possible")))

# --- embedding maintenance --------------------------------------------------------------------------------------

put("v4_occurrences_of_vectors", "SELECT DISTINCT c.id AS chunk_id, e.vec_id FROM chunks c JOIN semantic_embeddings e ON e.document_hash = c.hash",
    lambda s, d: table(s, d, "chunks").select(c("id").alias("chunk_id"), "hash").join(table(s, d, "semantic_embeddings").select(c("document_hash").alias("hash"), "vec_id"), "hash").select("chunk_id", "vec_id").distinct())
put("v5_dimension_check", "SELECT DISTINCT e.vec_id FROM semantic_embeddings e JOIN embedding_profiles p ON p.id = e.profile_id WHERE e.vec IS NOT NULL AND len(e.vec) <> p.dimensions",
    lambda s, d: table(s, d, "semantic_embeddings").join(F.broadcast(table(s, d, "embedding_profiles").select(c("id").alias("pid"), "dimensions")), c("profile_id") == c("pid")).filter(c("vec").isNotNull() & (F.size("vec") != c("dimensions"))).select("vec_id").distinct())
put("v6_semantic_documents", f"WITH {ART} SELECT id, sha256(concat_ws(chr(10), artifact_type, name, body)) AS document_hash FROM art",
    lambda s, d: artifacts(s, d).select("id", F.sha2(F.concat_ws("\n", "artifact_type", "name", "body"), 256).alias("document_hash")))
put("z12_two_sided_gap", "SELECT (SELECT count(*) FROM (SELECT DISTINCT hash FROM chunks WHERE hash NOT IN (SELECT document_hash FROM semantic_embeddings WHERE document_hash IS NOT NULL))) AS missing, (SELECT count(*) FROM (SELECT DISTINCT document_hash FROM semantic_embeddings WHERE document_hash NOT IN (SELECT hash FROM chunks WHERE hash IS NOT NULL))) AS orphans",
    lambda s, d: (lambda a, b: a.join(b, "h", "left_anti").agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.join(a, "h", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))))(
        table(s, d, "chunks").select(c("hash").alias("h")).distinct(), table(s, d, "semantic_embeddings").filter("document_hash IS NOT NULL").select(c("document_hash").alias("h")).distinct()))

# --- metrics ----------------------------------------------------------------------------------------------------

_FIRST = "first AS (SELECT query_id, min(r) AS rank FROM (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC NULLS LAST, artifact_id) AS r FROM (SELECT DISTINCT query_id, artifact_id, lexical_score FROM artifact_scores)) WHERE artifact_id IN (SELECT id FROM artifact_views WHERE confidence = 'likely' AND is_current) GROUP BY 1)"


def first_hits(s, d):
    w = Window.partitionBy("query_id").orderBy(c("lexical_score").desc_nulls_last(), "artifact_id")
    ranked = table(s, d, "artifact_scores").select("query_id", "artifact_id", "lexical_score").distinct().withColumn("r", F.row_number().over(w))
    gold = table(s, d, "artifact_views").filter("confidence = 'likely' AND is_current").select(c("id").alias("artifact_id")).distinct()
    return ranked.join(gold, "artifact_id", "left_semi").groupBy("query_id").agg(F.min("r").alias("rank"))


put("a24_hit_rates", f"WITH {_FIRST} SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_5, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_20, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM first",
    lambda s, d: A.hit_rates(first_hits(s, d), "rank"))
put("a25_precision_recall", """WITH p AS (SELECT query_id, list(DISTINCT artifact_id) FILTER (rank_score > 0.85) AS pred, list(DISTINCT artifact_id) FILTER (vector_cosine > 0.6) AS gold FROM artifact_scores GROUP BY 1),
q AS (SELECT query_id, coalesce(pred, []) AS pred, coalesce(gold, []) AS gold FROM p)
SELECT query_id, round(CASE WHEN len(pred) = 0 THEN (len(gold) = 0)::INT ELSE len(list_intersect(pred, gold)) / len(pred) END, 6)::DOUBLE AS precision, round(CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(pred, gold)) / len(gold) END, 6)::DOUBLE AS recall FROM q""",
    lambda s, d: table(s, d, "artifact_scores").groupBy("query_id").agg(F.collect_set(F.when(c("rank_score") > 0.85, c("artifact_id"))).alias("p"), F.collect_set(F.when(c("vector_cosine") > 0.6, c("artifact_id"))).alias("g")).select(
        "query_id", F.round(A.set_precision(c("p"), c("g")), 6).alias("precision"), F.round(A.set_recall(c("p"), c("g")), 6).alias("recall")))
put("a26_means_and_deltas", "SELECT query_id, round(avg(lexical_score), 6) AS lexical, round(avg(vector_cosine), 6) AS cosine, round(avg(rank_score) - avg(vector_cosine), 6) AS delta FROM artifact_scores GROUP BY 1",
    lambda s, d: table(s, d, "artifact_scores").groupBy("query_id").agg(F.round(F.avg("lexical_score"), 6).alias("lexical"), F.round(F.avg("vector_cosine"), 6).alias("cosine"), F.round(F.avg("rank_score") - F.avg("vector_cosine"), 6).alias("delta")))
put("a27_a28_a29_percentiles", """WITH o AS (SELECT query_id, rank_score, row_number() OVER (PARTITION BY query_id ORDER BY rank_score) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM artifact_scores WHERE rank_score IS NOT NULL)
SELECT query_id, round(median(rank_score), 6) AS median, round(max(CASE WHEN i = floor(0.95 * (n - 1)) THEN rank_score END), 6) AS lower_index, round(max(CASE WHEN i = ceil(0.95 * n) - 1 AND n >= 20 THEN rank_score END), 6) AS nearest_rank FROM o GROUP BY 1""",
    lambda s, d: A.percentiles(table(s, d, "artifact_scores"), "query_id", "rank_score", 0.95))
put("a30_cluster_bootstrap", None, lambda s, d: A.bootstrap_intervals(table(s, d, "events"), "event_type", "user_id", "value"))
put("a31_paired_difference", "SELECT a.query_id, a.artifact_id, round(a.m - b.m, 6) AS diff FROM (SELECT query_id, artifact_id, max(rank_score) AS m FROM artifact_scores GROUP BY ALL) a JOIN (SELECT query_id, artifact_id, max(vector_cosine) AS m FROM artifact_scores GROUP BY ALL) b USING (query_id, artifact_id)",
    lambda s, d: table(s, d, "artifact_scores").groupBy("query_id", "artifact_id").agg(F.round(F.max("rank_score") - F.max("vector_cosine"), 6).alias("diff")))
put("a32_micro_recall_gate", "SELECT round(sum(n)::DOUBLE / sum(t), 6) AS micro, bool_and(n * 1.0 / t >= 0.6) AS each FROM (SELECT query_id, count(DISTINCT artifact_id) FILTER (vector_cosine IS NOT NULL) AS n, count(DISTINCT artifact_id) AS t FROM artifact_scores GROUP BY 1)",
    lambda s, d: table(s, d, "artifact_scores").groupBy("query_id").agg(F.count_distinct(F.when(c("vector_cosine").isNotNull(), c("artifact_id"))).alias("n"), F.count_distinct("artifact_id").alias("t")).agg(
        F.round(F.sum("n") / F.sum("t"), 6).alias("micro"), F.bool_and(c("n") / c("t") >= 0.6).alias("each")))

# --- incremental ------------------------------------------------------------------------------------------------

_CLASS = """CASE WHEN regexp_matches(p, '(^|/)(\\.git|node_modules|dist|\\.next|coverage|out)(/|$)') AND NOT regexp_matches(p, '(^|/)\\.git/HEAD$') THEN 'ignore'
 WHEN regexp_matches(p, '(^|/)(package\\.json|pnpm-workspace\\.yaml|tsconfig[^/]*\\.json|\\.gitignore|HEAD)$') THEN 'boundary' WHEN regexp_matches(p, '\\.(js|jsx|ts|tsx|mjs|cjs|mts|cts)$') THEN 'source' ELSE 'external' END"""
put("l1_change_classes", f"SELECT p AS path, {_CLASS} AS class, count(*) AS n FROM (SELECT path AS p FROM files UNION ALL SELECT replace(path, '\\', '/') FROM walk_rejections) GROUP BY ALL",
    lambda s, d: table(s, d, "files").select("path").unionByName(table(s, d, "walk_rejections").select(F.translate("path", "\\", "/").alias("path"))).groupBy("path", L.classified(c("path")).alias("class")).agg(F.count(F.lit(1)).alias("n")))
_QUIET = 6 * 3600
_GEN = f"""g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) >= {_QUIET} THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)))"""
put("l2_l3_l5_generations", f"""WITH {_GEN} SELECT user_id, generation::BIGINT AS generation, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_signals, count(DISTINCT props) AS n_paths, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 0 END)::BIGINT AS scope,
count(DISTINCT props) > 256 OR max(CASE event_type WHEN 'purchase' THEN 3 ELSE 0 END) >= 3 AS full_refresh FROM g GROUP BY user_id, generation""",
    lambda s, d: L.merged(L.generations(table(s, d, "events"), "user_id", "ts", _QUIET), "user_id", "ts", "props", F.when(c("event_type") == "purchase", 3).when(c("event_type") == "click", 1).otherwise(0)))


def l3_stream(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "events").schema
    source = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return L.stream_sessions(s, source, "user_id", "ts", f"{_QUIET} seconds", "1 second")


put("l3_stream_sessions", None, l3_stream)
_VERSIONS = """o AS (SELECT id, arg_min(body, (exported_at, body)) AS digest, min(exported_at) AS at FROM artifact_views WHERE id IS NOT NULL AND exported_at < TIMESTAMP '2024-05-01' GROUP BY 1),
n AS (SELECT id, arg_max(body, (exported_at, body)) AS digest FROM artifact_views WHERE id IS NOT NULL AND is_current GROUP BY 1)"""


def versions(s, d):
    v = table(s, d, "artifact_views").filter("id IS NOT NULL")
    old = v.filter("exported_at < TIMESTAMP '2024-05-01'").groupBy("id").agg(F.min(F.struct("exported_at", "body")).alias("b")).select("id", c("b.body").alias("digest"))
    new = v.filter("is_current").groupBy("id").agg(F.max(F.struct("exported_at", "body")).alias("b")).select("id", c("b.body").alias("digest"))
    return old, new


put("l9_refresh_plan", f"WITH {_VERSIONS} SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.digest IS NOT DISTINCT FROM n.digest THEN 'kept' ELSE 'changed' END AS action FROM o FULL JOIN n ON o.id = n.id",
    lambda s, d: (lambda v: L.refresh_plan(v[0], v[1], "id", "digest"))(versions(s, d)))
put("l9_refreshed_equals_rebuild", f"WITH {_VERSIONS} SELECT id, length(digest) AS size FROM n",
    lambda s, d: (lambda o, n: L.refreshed(o.select("id", F.length("digest").cast("long").alias("size")), L.refresh_plan(o, n, "id", "digest"), "id", n.select("id", F.length("digest").cast("long").alias("size"))))(*versions(s, d)))
put("l10_no_op_digest", "SELECT sha256(count(*) || ':' || sum(('0x' || substr(sha256(path || chr(0) || hash), 1, 12))::BIGINT)::VARCHAR) AS snapshot, count(*) AS n FROM files",
    lambda s, d: table(s, d, "files").agg(X.set_digest(c("path"), c("hash")).alias("snapshot"), F.count(F.lit(1)).alias("n")))
