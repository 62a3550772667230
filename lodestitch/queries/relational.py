"""Filters, joins, aggregates, windows, sorts and set operations over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import retrieval as R
from ..operators.skew import positions
from ..session import table
from .registry import Registry
from .scalars import AREA_SQL

REG = Registry()
c = F.col


def put(name, sql, f):
    REG.add(name, sql)(f)


def origin(col="origin"):
    return F.lower(F.trim(c(col)))


def area_counts(s: SparkSession, d: str) -> DataFrame:
    """Files, chunks and named chunks per repository area: each counted per file before the join, so no fan-out."""
    files = table(s, d, "files").select(c("id").alias("fid"), X.repository_area(c("path")).alias("area"))
    per_file = table(s, d, "chunks").groupBy("file_id").agg(F.count(F.lit(1)).alias("nc"), F.count("name").alias("nn"))
    return files.join(per_file, c("fid") == c("file_id"), "left").groupBy("area").agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("nc"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("nn"), F.lit(0)).alias("n_symbols")
    )


def spread_sample(s: SparkSession, df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows evenly spaced over the order of the unique ``key``: places i * (rows - 1) div (n - 1)."""
    at = positions(s, df, [key]).select(key, (c("position") - 1).alias("place")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("rows"))))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (c("rows") - 1) / (n - 1)))
    return at.filter(F.array_contains(picks, c("place"))).select(key, "place")


# --- filters ----------------------------------------------------------------------------------------------------

put("f1_origin_allow_list", "SELECT id FROM files WHERE lower(trim(origin)) IN ('repository', 'workspace')",
    lambda s, d: table(s, d, "files").filter(origin().isin("repository", "workspace")).select("id"))
put("f2_optional_in_list", "SELECT id, role FROM files WHERE role IN ('production', 'test')",
    lambda s, d: (lambda roles: (lambda f: f.filter(c("role").isin(roles)) if roles else f)(table(s, d, "files")).select("id", "role"))(["production", "test"]))
put("f3_optional_equality", "SELECT id FROM files WHERE repo = 'atlas-mono'", lambda s, d: table(s, d, "files").filter(c("repo") == "atlas-mono").select("id"))
put("f4_substring_ignoring_case", "SELECT id, name FROM chunks WHERE instr(lower(name), 'invoice') > 0",
    lambda s, d: table(s, d, "chunks").filter(F.instr(F.lower("name"), "invoice") > 0).select("id", "name"))
put("f5_suffix_match", "SELECT id, path FROM files WHERE path LIKE '%.spec.ts'", lambda s, d: table(s, d, "files").filter(c("path").endswith(".spec.ts")).select("id", "path"))
put("f6_path_and_name", "SELECT c.id FROM chunks c JOIN files f ON f.id = c.file_id WHERE contains(f.path, 'billing') AND c.name = (SELECT min(name) FROM chunks x JOIN files g ON g.id = x.file_id WHERE contains(g.path, 'billing'))",
    lambda s, d: (lambda r: r.join(F.broadcast(r.agg(F.min("name").alias("wanted"))), c("name") == c("wanted")).select("id"))(
        table(s, d, "chunks").join(table(s, d, "files").filter(c("path").contains("billing")).select(c("id").alias("fid")), c("file_id") == c("fid"))))
put("f9_confidence_floor", "SELECT DISTINCT id, confidence FROM artifact_views WHERE confidence IN ('likely', 'certain')",
    lambda s, d: table(s, d, "artifact_views").filter(X.confidence_rank(c("confidence")) >= 2).select("id", "confidence").distinct())
put("f10_f11_product_scope", "SELECT f.id FROM files f LEFT JOIN package_instances p ON p.id = f.package_instance_id WHERE p.status = 'complete' OR (p.id IS NULL AND f.role IN ('production', 'unknown'))",
    lambda s, d: table(s, d, "files").join(table(s, d, "package_instances").select(c("id").alias("pid"), "status"), c("package_instance_id") == c("pid"), "left").filter(
        (c("status") == "complete") | (c("pid").isNull() & c("role").isin("production", "unknown"))).select("id"))
put("f12_effective_runtime", "SELECT id, CASE WHEN path LIKE 'packages/core/%' THEN true WHEN path LIKE 'node_modules/%' THEN false ELSE coalesce(role = 'production', false) END AS runtime FROM files",
    lambda s, d: table(s, d, "files").select("id", F.when(c("path").startswith("packages/core/"), True).when(c("path").startswith("node_modules/"), False).otherwise(
        F.coalesce(c("role") == "production", F.lit(False))).alias("runtime")))
put("f13_identifier_intent", r"SELECT item_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_$]+'), lambda t: regexp_matches(t, '[a-z][A-Z]|_|\$'))) AS n_identifiers FROM eval_items",
    lambda s, d: table(s, d, "eval_items").select("item_id", F.size(F.filter(X.identifier_tokens(c("text")), lambda t: t.rlike(r"[a-z][A-Z]|_|\$"))).cast("long").alias("n_identifiers")))
put("f15_receiver_suffix", "SELECT DISTINCT scope_chain FROM chunks WHERE scope_chain IS NOT NULL AND string_split(scope_chain, '.')[-1] = (SELECT min(string_split(scope_chain, '.')[-1]) FROM chunks WHERE scope_chain <> '')",
    lambda s, d: (lambda r: r.crossJoin(F.broadcast(r.filter("scope_chain <> ''").agg(F.min(F.element_at(F.split("scope_chain", r"\."), -1)).alias("wanted")))).filter(
        F.slice(F.split("scope_chain", r"\."), -1, 1) == F.array("wanted")).select("scope_chain").distinct())(table(s, d, "chunks").filter("scope_chain IS NOT NULL").select("scope_chain")))
put("f16_argument_filter", """SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7 AND event_type = 'click'""",
    lambda s, d: table(s, d, "events").filter((F.get_json_object("props", "$.k").cast("long") == 7) & (c("event_type") == "click")).select("event_id"))
put("f17_scope_membership", "SELECT id, NOT contains(substr(path, length('packages/core/') + 1), '/') AS direct FROM files WHERE starts_with(path, 'packages/core/')",
    lambda s, d: table(s, d, "files").filter(c("path").startswith("packages/core/")).select("id", (~F.expr("substring(path, length('packages/core/') + 1)").contains("/")).alias("direct")))
put("f18_value_domains", "SELECT id, role, origin FROM files WHERE role IS NULL OR role NOT IN ('production', 'test', 'fixture', 'generated', 'documentation', 'unknown') OR origin NOT IN ('repository', 'workspace', 'dependency')",
    lambda s, d: table(s, d, "files").filter(c("role").isNull() | ~c("role").isin(*X.ROLE_PENALTY) | ~c("origin").isin("repository", "workspace", "dependency")).select("id", "role", "origin"))

# --- joins ------------------------------------------------------------------------------------------------------

put("j1_inner_dimension", "SELECT c.id, f.path FROM chunks c JOIN files f ON f.id = c.file_id",
    lambda s, d: table(s, d, "chunks").select("id", "file_id").join(table(s, d, "files").select(c("id").alias("fid"), "path"), c("file_id") == c("fid")).select("id", "path"))
put("j2_left_dimension", "SELECT f.id, p.name AS package FROM files f LEFT JOIN package_instances p ON p.id = f.package_instance_id",
    lambda s, d: table(s, d, "files").select("id", "package_instance_id").join(table(s, d, "package_instances").select(c("id").alias("pid"), c("name").alias("package")), c("package_instance_id") == c("pid"), "left").select("id", "package"))
put("j3_left_composite_with_guard", "SELECT c.id, s.artifact_id FROM (SELECT DISTINCT query_id, artifact_id FROM artifact_scores) s RIGHT JOIN (SELECT DISTINCT id, name FROM artifact_views) c ON c.id = s.artifact_id AND s.query_id = 1 AND c.name LIKE 'no%'",
    lambda s, d: table(s, d, "artifact_views").select("id", "name").distinct().join(table(s, d, "artifact_scores").filter("query_id = 1").select("artifact_id").distinct(),
        (c("id") == c("artifact_id")) & c("name").startswith("no"), "left").select("id", "artifact_id"))
put("j10_declaration_mapping", """WITH p AS (SELECT a.id, b.id AS other, a.hash = b.hash AS same, rank() OVER (PARTITION BY a.id ORDER BY b.end_byte - b.start_byte) AS r FROM chunks a JOIN chunks b
ON a.file_id = b.file_id AND a.name = b.name AND b.start_byte <= a.start_byte AND b.end_byte >= a.end_byte)
SELECT id, CASE WHEN count(*) = 1 AND bool_and(same) THEN min(other) END AS mapped FROM p WHERE r = 1 GROUP BY 1""",
    lambda s, d: (lambda a, b: a.join(b, (c("file_id") == c("bf")) & (c("name") == c("bn")) & (c("bs") <= c("start_byte")) & (c("be") >= c("end_byte"))).withColumn(
        "r", F.rank().over(Window.partitionBy("id").orderBy(c("be") - c("bs")))).filter("r = 1").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(c("hash") == c("bh")).alias("same"), F.min("other").alias("o")).select("id", F.when((c("n") == 1) & c("same"), c("o")).alias("mapped")))(
        table(s, d, "chunks").select("id", "file_id", "name", "start_byte", "end_byte", "hash"),
        table(s, d, "chunks").select(c("id").alias("other"), c("file_id").alias("bf"), c("name").alias("bn"), c("start_byte").alias("bs"), c("end_byte").alias("be"), c("hash").alias("bh"))))
put("j12_semi_join", "SELECT id FROM files f WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = f.id AND c.name IS NOT NULL)",
    lambda s, d: table(s, d, "files").select("id").join(table(s, d, "chunks").filter("name IS NOT NULL").select("file_id"), c("id") == c("file_id"), "left_semi"))
put("j14_missing_embeddings", "SELECT DISTINCT hash FROM chunks WHERE hash NOT IN (SELECT document_hash FROM semantic_embeddings WHERE document_hash IS NOT NULL)",
    lambda s, d: table(s, d, "chunks").select("hash").distinct().join(table(s, d, "semantic_embeddings").select(c("document_hash").alias("hash")), "hash", "left_anti"))
put("j15_j16_orphans", "SELECT DISTINCT vec_id FROM semantic_embeddings e WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.hash = e.document_hash)",
    lambda s, d: table(s, d, "semantic_embeddings").select("vec_id", c("document_hash").alias("hash")).join(table(s, d, "chunks").select("hash"), "hash", "left_anti").select("vec_id").distinct())
put("j18_validity_join", """SELECT o.o_orderkey, c.c_name, n.n_name, sum(l.l_quantity) AS quantity FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE r.r_name = 'ASIA' AND l.l_shipdate >= o.o_orderdate GROUP BY ALL""",
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(table(s, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(
        table(s, d, "region").filter("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey")).join(table(s, d, "lineitem"), (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") >= c("o_orderdate"))).groupBy(
        "o_orderkey", "c_name", "n_name").agg(F.sum("l_quantity").alias("quantity")))
put("j22_either_endpoint", "SELECT x.id, count(*) AS n FROM (SELECT DISTINCT id FROM artifact_views) x JOIN (SELECT DISTINCT id AS a, supersedes AS b FROM artifact_views WHERE supersedes IS NOT NULL) e ON e.a = x.id OR e.b = x.id GROUP BY 1",
    lambda s, d: (lambda e, v: e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).join(v, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")))(
        table(s, d, "artifact_views").filter("supersedes IS NOT NULL").select(c("id").alias("a"), c("supersedes").alias("b")).distinct(), table(s, d, "artifact_views").select("id")))
put("j23_set_comparison", """WITH a AS (SELECT file_id, list_sort(list(DISTINCT hash)) AS h FROM chunks GROUP BY 1)
SELECT x.file_id AS a_file, y.file_id AS b_file FROM a x JOIN a y ON x.h = y.h AND x.file_id < y.file_id WHERE len(x.h) > 1""",
    lambda s, d: (lambda a: a.select(c("file_id").alias("a_file"), "key").join(a.select(c("file_id").alias("b_file"), c("key").alias("k2")), (c("key") == c("k2")) & (c("a_file") < c("b_file"))).select("a_file", "b_file"))(
        table(s, d, "chunks").groupBy("file_id").agg(F.array_sort(F.collect_set("hash")).alias("h")).filter(F.size("h") > 1).select("file_id", F.sha2(F.array_join("h", ","), 256).alias("key"))))

# --- aggregates -------------------------------------------------------------------------------------------------

put("a1_a2_area_rollup", f"""SELECT area, count(*) AS n_files, coalesce(sum(nc), 0)::BIGINT AS n_chunks, coalesce(sum(nn), 0)::BIGINT AS n_symbols FROM (SELECT id, {AREA_SQL} AS area FROM files) f
LEFT JOIN (SELECT file_id, count(*) AS nc, count(name) AS nn FROM chunks GROUP BY 1) k ON k.file_id = f.id GROUP BY 1""", area_counts)
put("a3_two_distinct_counts", "SELECT repo, count(DISTINCT role) AS roles, count(DISTINCT origin) AS origins FROM files GROUP BY 1",
    lambda s, d: table(s, d, "files").groupBy("repo").agg(F.count_distinct("role").alias("roles"), F.count_distinct("origin").alias("origins")))
put("a5_group_min_order", "SELECT name, min(file_id) AS first_file, min(start_byte) AS first_byte FROM chunks WHERE name IS NOT NULL GROUP BY 1",
    lambda s, d: table(s, d, "chunks").filter("name IS NOT NULL").groupBy("name").agg(F.min("file_id").alias("first_file"), F.min("start_byte").alias("first_byte")))
put("a6_hash_integrity", "SELECT hash, count(DISTINCT content) AS n_contents FROM chunks GROUP BY 1",
    lambda s, d: table(s, d, "chunks").groupBy("hash").agg(F.count_distinct("content").alias("n_contents")))
put("a7_distinct_hash_count", "SELECT count(*) AS n FROM (SELECT DISTINCT hash FROM chunks)", lambda s, d: table(s, d, "chunks").select("hash").distinct().agg(F.count(F.lit(1)).alias("n")))
put("a8_demotion", """SELECT artifact_id, count(*) AS n, CASE WHEN count(*) > 3 OR min(CASE WHEN rank_score < 0.7 THEN 0 ELSE 1 END) = 0 THEN 'possible' ELSE 'likely' END AS confidence
FROM (SELECT DISTINCT query_id, artifact_id, rank_score FROM artifact_scores) GROUP BY 1""",
    lambda s, d: table(s, d, "artifact_scores").select("query_id", "artifact_id", "rank_score").distinct().groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(c("rank_score") < 0.7).alias("weak")).select("artifact_id", "n", F.when((c("n") > 3) | F.coalesce("weak", F.lit(False)), "possible").otherwise("likely").alias("confidence")))
put("a9_bool_fold", "SELECT repo, NOT bool_or(coalesce(role = 'production', false)) AS never_production FROM files GROUP BY 1",
    lambda s, d: table(s, d, "files").groupBy("repo").agg((~F.bool_or(F.coalesce(c("role") == "production", F.lit(False)))).alias("never_production")))
put("a11_ordered_distinct_concat", "SELECT repo, array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), chr(10)) AS roles FROM files GROUP BY 1",
    lambda s, d: table(s, d, "files").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("role")), "\n").alias("roles")))
put("a14_w3_ordinals", "SELECT id, row_number() OVER (PARTITION BY file_id, name ORDER BY start_byte, id) AS ordinal FROM chunks",
    lambda s, d: table(s, d, "chunks").select("id", F.row_number().over(Window.partitionBy("file_id", "name").orderBy("start_byte", "id")).cast("long").alias("ordinal")))
put("a15_set_collection", "SELECT repo, array_to_string(list_sort(list(DISTINCT stage) FILTER (stage IS NOT NULL)), ',') AS stages FROM walk_rejections GROUP BY 1",
    lambda s, d: table(s, d, "walk_rejections").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages")))
put("a18_path_floors", "SELECT id, least(CASE confidence WHEN 'certain' THEN 1.0 WHEN 'likely' THEN 0.6 ELSE 0.3 END, coalesce(support_count, 0) / 20.0)::DOUBLE AS floor FROM (SELECT DISTINCT id, confidence, support_count FROM artifact_views)",
    lambda s, d: table(s, d, "artifact_views").select("id", "confidence", "support_count").distinct().select("id", F.least(X.confidence_weight(c("confidence")), F.coalesce("support_count", F.lit(0)) / 20.0).alias("floor")))
put("a19_relation_digest", "SELECT repo, sha256(count(*) || ':' || sum(('0x' || substr(sha256(path || chr(0) || hash), 1, 12))::BIGINT)::VARCHAR) AS digest FROM files GROUP BY 1",
    lambda s, d: table(s, d, "files").groupBy("repo").agg(X.set_digest(c("path"), c("hash")).alias("digest")))
put("a21_counts_by_decision", "SELECT lower(trim(stage)) AS stage, count(*) AS n FROM walk_rejections GROUP BY 1", lambda s, d: table(s, d, "walk_rejections").groupBy(F.lower(F.trim("stage")).alias("stage")).agg(F.count(F.lit(1)).alias("n")))
put("a22_role_counts_per_scope", f"SELECT {AREA_SQL} AS area, coalesce(lower(role), 'none') AS role, count(*) AS n FROM files GROUP BY ALL",
    lambda s, d: table(s, d, "files").groupBy(X.repository_area(c("path")).alias("area"), F.coalesce(F.lower("role"), F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n")))
put("a23_expected_sets", "SELECT lower(name) AS term, array_to_string(list_sort(list(DISTINCT id)), ',') AS artifacts FROM artifact_views WHERE name IS NOT NULL GROUP BY 1",
    lambda s, d: table(s, d, "artifact_views").filter("name IS NOT NULL").groupBy(F.lower("name").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("artifacts")))
put("a33_verdict_pivot", "SELECT repo, count(*) FILTER (lower(trim(stage)) = 'parse') AS parse, count(*) FILTER (lower(trim(stage)) = 'read') AS read, bool_or(stage IS NULL) AS any_null FROM walk_rejections GROUP BY 1",
    lambda s, d: (lambda w: w.groupBy("repo").pivot("st", ["parse", "read"]).agg(F.count(F.lit(1))).join(w.groupBy("repo").agg(F.bool_or(c("stage").isNull()).alias("any_null")), "repo").select(
        "repo", F.coalesce("parse", F.lit(0)).alias("parse"), F.coalesce("read", F.lit(0)).alias("read"), "any_null"))(table(s, d, "walk_rejections").withColumn("st", F.lower(F.trim("stage")))))
put("a34_missing_cells", "SELECT r.repo, o.role FROM (SELECT DISTINCT repo FROM files) r, (SELECT DISTINCT role FROM files WHERE role IS NOT NULL) o WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = r.repo AND f.role = o.role)",
    lambda s, d: (lambda f: f.select("repo").distinct().crossJoin(F.broadcast(f.filter("role IS NOT NULL").select("role").distinct())).join(f.select("repo", "role"), ["repo", "role"], "left_anti"))(table(s, d, "files")))
put("a35_telemetry_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS most, round(count(*) / (SELECT count(*) FROM events), 6)::DOUBLE AS share FROM events GROUP BY 1",
    lambda s, d: (lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("most")).crossJoin(
        F.broadcast(e.agg(F.count(F.lit(1)).alias("all_rows")))).select("event_type", "n", "total", "most", F.round(c("n") / c("all_rows"), 6).alias("share")))(table(s, d, "events")))
put("s26_statistics", "SELECT count(*) AS n_chunks, count(DISTINCT file_id) AS n_files, count(name) AS n_named, sum(end_line - start_line + 1)::BIGINT AS n_lines FROM chunks",
    lambda s, d: table(s, d, "chunks").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("file_id").alias("n_files"), F.count("name").alias("n_named"), F.sum(c("end_line") - c("start_line") + 1).alias("n_lines")))

# --- windows, sorts, limits -------------------------------------------------------------------------------------

put("w1_total_over_result", "SELECT id, count(*) OVER () AS matched FROM files WHERE role = 'test'",
    lambda s, d: (lambda f: f.crossJoin(F.broadcast(f.agg(F.count(F.lit(1)).alias("matched")))))(table(s, d, "files").filter("role = 'test'").select("id")))
put("w2_rank_position", "SELECT id, row_number() OVER (ORDER BY support_count DESC, id) AS rank FROM (SELECT id, max(support_count) AS support_count FROM artifact_views GROUP BY 1) ORDER BY rank LIMIT 100",
    lambda s, d: R.top(table(s, d, "artifact_views").groupBy("id").agg(F.max("support_count").alias("support_count")), [c("support_count").desc_nulls_last(), c("id")], 100).select("id", "rank"))
put("w4_keep_first", "SELECT hash, arg_min(id, (file_id, start_byte, id)) AS id FROM chunks GROUP BY 1",
    lambda s, d: table(s, d, "chunks").groupBy("hash").agg(F.min(F.struct("file_id", "start_byte", "id")).alias("b")).select("hash", c("b.id").alias("id")))
put("w5_top_n_per_parent", "SELECT file_id, id, rank FROM (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY start_byte, id) AS rank FROM chunks) WHERE rank <= 4",
    lambda s, d: R.top_per_group(table(s, d, "chunks").select("file_id", "id", "start_byte"), ["file_id"], [c("start_byte"), c("id")], 4).select("file_id", "id", "rank"))
put("w7_round_robin_scopes", "SELECT id, row_number() OVER (ORDER BY depth, repo, id) AS position FROM (SELECT id, repo, row_number() OVER (PARTITION BY repo ORDER BY id) AS depth FROM files)",
    lambda s, d: R.round_robin(s, table(s, d, "files").select("id", "repo"), "id", "repo", [c("id")]).select("id", "position"))
put("w8_nested_round_robin", """WITH a AS (SELECT c.id, f.repo, c.file_id, row_number() OVER (PARTITION BY c.file_id ORDER BY c.start_byte, c.id) AS round FROM chunks c JOIN files f ON f.id = c.file_id),
b AS (SELECT id, repo, row_number() OVER (PARTITION BY repo ORDER BY round, file_id, id) AS place FROM a)
SELECT id, row_number() OVER (ORDER BY place, repo) AS position FROM b""",
    lambda s, d: positions(s, table(s, d, "chunks").select("id", "file_id", "start_byte").join(table(s, d, "files").select(c("id").alias("fid"), "repo"), c("file_id") == c("fid")).withColumn(
        "round", F.row_number().over(Window.partitionBy("file_id").orderBy("start_byte", "id"))).withColumn(
        "place", F.row_number().over(Window.partitionBy("repo").orderBy("round", "file_id", "id"))), ["place", "repo", "id"]).select("id", "position"))
put("w9_even_sample", "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM files) WHERE place IN (SELECT i * (n2 - 1) // 7 FROM range(8) t(i), (SELECT count(*) AS n2 FROM files))",
    lambda s, d: spread_sample(s, table(s, d, "files"), "id", 8))
put("w10_latest_valid", "SELECT id, exported_at FROM (SELECT id, exported_at, row_number() OVER (PARTITION BY id ORDER BY exported_at DESC) AS n FROM artifact_views WHERE freshness = 'fresh') WHERE n = 1",
    lambda s, d: table(s, d, "artifact_views").filter("freshness = 'fresh'").groupBy("id").agg(F.max("exported_at").alias("exported_at")))
put("w11_last_writer_by_specificity", """SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY len(string_split(path, '/')) DESC, length(path) DESC, id DESC) AS n FROM files) WHERE n = 1""",
    lambda s, d: table(s, d, "files").groupBy("repo").agg(F.max(F.struct(F.size(F.split("path", "/")).alias("k"), F.length("path").alias("l"), "id", "path")).alias("b")).select("repo", "b.path"))
put("t1_order_and_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25",
    lambda s, d: table(s, d, "documents").orderBy(c("n_chars").desc(), "doc_id").limit(25).select("doc_id", "n_chars"))
put("t4_byte_budget_prefix", """SELECT chunk_id, used FROM (SELECT id AS chunk_id, sum(strlen(content)) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM chunks WHERE file_id = (SELECT min(file_id) FROM chunks)) WHERE used <= 24000""",
    lambda s, d: (lambda k: k.join(F.broadcast(k.agg(F.min("file_id").alias("first"))), c("file_id") == c("first")).select(c("id").alias("chunk_id"), F.sum(F.octet_length("content")).over(
        Window.partitionBy("file_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("used")).filter("used <= 24000"))(table(s, d, "chunks")))
put("t6_seed_cap_two_passes", "SELECT id, is_file, rank FROM (SELECT id, name IS NULL AS is_file, row_number() OVER (ORDER BY name IS NULL, id) AS rank FROM chunks) WHERE rank <= 40",
    lambda s, d: R.top(table(s, d, "chunks").select("id", c("name").isNull().alias("is_file")), [c("is_file"), c("id")], 40))
put("t8_truncation_flags", "SELECT repo, least(count(*), 20)::BIGINT AS shown, greatest(count(*) - 20, 0)::BIGINT AS omitted FROM files GROUP BY 1",
    lambda s, d: table(s, d, "files").groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select("repo", F.least(c("n"), F.lit(20)).cast("long").alias("shown"), F.greatest(c("n") - 20, F.lit(0)).cast("long").alias("omitted")))

# --- set operations ---------------------------------------------------------------------------------------------

put("u1_u2_union_all", "SELECT hash FROM files UNION ALL SELECT hash FROM chunks", lambda s, d: table(s, d, "files").select("hash").unionByName(table(s, d, "chunks").select("hash")))
put("u3_union_distinct", "SELECT name FROM package_instances UNION SELECT name FROM chunks", lambda s, d: table(s, d, "package_instances").select("name").union(table(s, d, "chunks").select("name")).distinct())
put("u5_removed_paths", "SELECT repo, path FROM walk_rejections EXCEPT SELECT repo, path FROM files", lambda s, d: table(s, d, "walk_rejections").select("repo", "path").subtract(table(s, d, "files").select("repo", "path")))
put("u6_distinct", "SELECT DISTINCT file_id, name FROM chunks", lambda s, d: table(s, d, "chunks").select("file_id", "name").distinct())
put("u8_merge_keeping_best", "SELECT artifact_id, round(max(score), 6) AS score FROM (SELECT artifact_id, rank_score AS score FROM artifact_scores UNION ALL SELECT artifact_id, vector_cosine FROM artifact_scores) GROUP BY 1",
    lambda s, d: (lambda a: a.select("artifact_id", c("rank_score").alias("score")).union(a.select("artifact_id", "vector_cosine")).groupBy("artifact_id").agg(F.round(F.max("score"), 6).alias("score")))(table(s, d, "artifact_scores")))
put("u9_set_equality", "SELECT a.repo AS a, b.repo AS b FROM (SELECT repo, list_sort(list(DISTINCT lower(trim(role)))) AS r FROM files WHERE role IS NOT NULL GROUP BY 1) a JOIN (SELECT repo, list_sort(list(DISTINCT lower(trim(role)))) AS r FROM files WHERE role IS NOT NULL GROUP BY 1) b ON a.r = b.r AND a.repo < b.repo",
    lambda s, d: (lambda x: x.select(c("repo").alias("a"), "r").join(x.select(c("repo").alias("b"), c("r").alias("r2")), (c("r") == c("r2")) & (c("a") < c("b"))).select("a", "b"))(
        table(s, d, "files").filter("role IS NOT NULL").groupBy("repo").agg(F.array_sort(F.collect_set(F.lower(F.trim("role")))).alias("r"))))
