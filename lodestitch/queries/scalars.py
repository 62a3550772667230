"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import udfs
from ..session import table
from .registry import Registry

REG = Registry()
c = F.col


def put(name, sql, f):
    REG.add(name, sql)(f)


def _map(values: dict) -> str:
    return "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())


put("x1_fts_query", """
SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_$]+'), lambda t: '"' || t || '"'), ' OR ') AS match_query FROM eval_items""",
    lambda s, d: table(s, d, "eval_items").select("item_id", X.fts_query(c("text")).alias("match_query")))

put("x2_identifier_tokens", """
SELECT id AS chunk_id, len(regexp_extract_all(content, '[A-Za-z0-9_$]+')) AS n_tokens,
  len(list_distinct(regexp_extract_all(content, '[A-Za-z0-9_$]+'))) AS n_distinct FROM chunks""",
    lambda s, d: table(s, d, "chunks").select(
        c("id").alias("chunk_id"), F.size(X.identifier_tokens(c("content"))).cast("long").alias("n_tokens"),
        F.size(F.array_distinct(X.identifier_tokens(c("content")))).cast("long").alias("n_distinct")))

put("x3_semantic_tokens", """
SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(body, '[A-Za-z0-9_$]+'), lambda t: lower(t)), lambda t: strlen(t) > 1), ' ') AS tokens
FROM (SELECT DISTINCT id, body FROM artifact_views)""",
    lambda s, d: table(s, d, "artifact_views").select("id", "body").distinct().select(
        "id", F.array_join(X.semantic_tokens(c("body")), " ").alias("tokens")))

_REL_QUERY = "loads the digest of each trace"
put("x4_lexical_artifact_relevance", f"""
WITH a AS (SELECT DISTINCT id, name, body FROM artifact_views),
q AS (SELECT list_distinct(list_filter(list_transform(regexp_extract_all('{_REL_QUERY}', '[A-Za-z0-9_$]+'), lambda t: lower(t)), lambda t: strlen(t) > 1)) AS toks),
m AS (SELECT id, name, len(list_intersect(toks, list_filter(list_transform(regexp_extract_all(concat_ws(' ', name, body), '[A-Za-z0-9_$]+'),
  lambda t: lower(t)), lambda t: strlen(t) > 1))) AS n, len(toks) AS total FROM a, q)
SELECT id, name, round(least(1.0, (n + CASE WHEN lower(name) = '{_REL_QUERY}' THEN 4 ELSE 0 END) / total), 6) AS relevance FROM m WHERE n > 0""",
    lambda s, d: table(s, d, "artifact_views").select("id", "name", "body").distinct().select(
        "id", "name", F.round(X.lexical_relevance(F.lit(_REL_QUERY), c("name"), c("body")), 6).alias("relevance")
    ).filter(c("relevance").isNotNull()))

put("x5_normalize", None, lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(udfs.normalize("text"), 256).alias("normal_digest")))

_ROLES = _map(X.ROLE_PENALTY).format("role") + " ELSE 0 END"
put("x10_role_penalty", f"SELECT id, CASE WHEN role IS NULL THEN 1.0 ELSE {_ROLES} END::DOUBLE AS penalty FROM files",
    lambda s, d: table(s, d, "files").select("id", X.role_penalty(c("role")).alias("penalty")))

put("x6_weights", f"""
SELECT DISTINCT confidence, ({_map(X.CONFIDENCE_WEIGHT).format('confidence')} ELSE 0 END)::DOUBLE AS weight,
  ({_map(X.CONFIDENCE_RANK).format('confidence')} ELSE 0 END)::BIGINT AS rank FROM artifact_views""",
    lambda s, d: table(s, d, "artifact_views").select(
        "confidence", X.confidence_weight(c("confidence")).alias("weight"), X.confidence_rank(c("confidence")).cast("long").alias("rank")).distinct())

put("x7_x8_decay_and_damping", """
SELECT id, round(pow(0.75, coalesce(support_count, 1) % 8), 6) AS decay, round(1.0 / log2(coalesce(support_count, 0) + 2), 6) AS damping
FROM (SELECT DISTINCT id, support_count FROM artifact_views)""",
    lambda s, d: table(s, d, "artifact_views").select("id", "support_count").distinct().select(
        "id", X.round_score(X.distance_decay(F.coalesce("support_count", F.lit(1)) % 8 + 1)).alias("decay"),
        X.round_score(X.hub_damping(F.coalesce("support_count", F.lit(0)))).alias("damping")))

put("x11_effective_role", """
SELECT id, CASE WHEN role IN ('test', 'fixture', 'generated') THEN role WHEN path LIKE 'packages/%' THEN 'runtime' ELSE role END AS effective_role FROM files""",
    lambda s, d: table(s, d, "files").select(
        "id", X.effective_role(c("role"), F.when(c("path").startswith("packages/"), "runtime")).alias("effective_role")))

AREA_SQL = """CASE WHEN len(string_split(path, '/')) < 2 THEN '.'
 WHEN string_split(path, '/')[1] = 'node_modules' THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ||
   CASE WHEN string_split(path, '/')[2] LIKE '@%' AND len(string_split(path, '/')) > 2 THEN '/' || string_split(path, '/')[3] ELSE '' END
 WHEN string_split(path, '/')[1] IN ('packages', 'apps', 'services', 'src') AND len(string_split(path, '/')) > 2
   THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"""
put("x12_repository_area", f"SELECT id, {AREA_SQL} AS area FROM files",
    lambda s, d: table(s, d, "files").select("id", X.repository_area(c("path")).alias("area")))

_ROUTE = r"""path:\s*['"]([^'"]*)['"]"""
put("x13_routes", f"""
SELECT DISTINCT r AS raw, '/' || trim(r, '/') AS route, CASE WHEN trim(r, '/') = '' THEN '/api' ELSE '/api/' || trim(r, '/') END AS joined
FROM (SELECT unnest(regexp_extract_all(content, '{_ROUTE.replace("'", "''")}', 1)) AS r FROM source_files)""",
    lambda s, d: table(s, d, "source_files").select(F.explode(F.regexp_extract_all("content", F.lit(_ROUTE), 1)).alias("raw")).distinct().select(
        "raw", X.trimmed_route(c("raw")).alias("route"), X.join_route(F.lit("api/"), c("raw")).alias("joined")))

put("x14_url_host", r"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '.example.org' WHEN event_id % 3 = 1 THEN '::1' END AS host FROM events""",
    lambda s, d: table(s, d, "events").select("event_id", X.url_host(
        F.when(c("event_id") % 3 == 0, F.concat(F.lit("HTTPS://u:p@"), F.upper("event_type"), F.lit(".Example.org:8080/x?y=http://z")))
        .when(c("event_id") % 3 == 1, F.lit("http://[::1]:80/")).otherwise(c("event_type"))).alias("host")))

put("x15_mutation_resource", r"""
WITH n AS (SELECT DISTINCT name FROM chunks WHERE name IS NOT NULL UNION SELECT DISTINCT 'create' || upper(name[1]) || name[2:] FROM chunks WHERE name IS NOT NULL)
SELECT name, CASE regexp_extract(name, '^(create|update|delete)[A-Z]', 1) WHEN 'create' THEN 'created' WHEN 'update' THEN 'updated' ELSE 'deleted' END AS event,
  lower(r[1]) || r[2:] AS resource FROM (SELECT name, regexp_extract(name, '^(?:create|update|delete)([A-Z]\w*)$', 1) AS r FROM n) WHERE r <> ''""",
    lambda s, d: (lambda n: n.select("name", X.mutation_resource(c("name"))[0].alias("event"), X.mutation_resource(c("name"))[1].alias("resource")).filter("resource IS NOT NULL"))(
        (lambda k: k.union(k.select(F.concat(F.lit("create"), F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")))).distinct())(
            table(s, d, "chunks").select("name").filter("name IS NOT NULL"))))

put("x16_holder_resource", r"""
SELECT name, regexp_extract(name, '(?i)^(\w+?)(?:repository|repo|model)$', 1) AS resource
FROM (SELECT DISTINCT name || CASE WHEN length(name) % 2 = 0 THEN 'Repository' ELSE 'Model' END AS name FROM chunks WHERE name IS NOT NULL) WHERE resource <> ''""",
    lambda s, d: table(s, d, "chunks").filter("name IS NOT NULL").select(
        F.concat("name", F.when(F.length("name") % 2 == 0, "Repository").otherwise("Model")).alias("name")).distinct().select(
        "name", X.holder_resource(c("name")).alias("resource")).filter("resource IS NOT NULL"))

put("x19_encode_key", None, lambda s, d: table(s, d, "files").select("id", X.encoded_key(c("path")).alias("path_key")))

IMPORT = r"""\bfrom\s+['"]([^'"]+)['"]"""
_IMPORT_SQL = f"SELECT file_id, unnest(regexp_extract_all(content, '{IMPORT.replace(chr(39), chr(39) * 2)}', 1)) AS request FROM source_files"
put("x21_package_name", f"""
SELECT DISTINCT request, CASE WHEN NOT regexp_matches(request, '^(?:\\.{{0,2}}/|\\.{{1,2}}$|[a-z]+:|#)') AND request <> ''
  THEN regexp_extract(request, '^(@[^/]+/[^/]+|[^/]+)', 1) END AS package FROM ({_IMPORT_SQL})""",
    lambda s, d: table(s, d, "source_files").select(F.explode(F.regexp_extract_all("content", F.lit(IMPORT), 1)).alias("request")).distinct().select(
        "request", X.package_name(c("request")).alias("package")))

put("x22_truncate_utf8", None, lambda s, d: table(s, d, "documents").select(
    "doc_id", X.truncated_utf8(c("text"), 200).alias("head"), F.octet_length(X.truncated_utf8(c("text"), 200)).cast("long").alias("n_bytes")))

put("x23_line_excerpt", """
SELECT id AS chunk_id, CASE WHEN len(string_split(content, chr(10))) >= 4 THEN array_to_string(string_split(content, chr(10))[2:4], chr(10)) END AS excerpt FROM chunks""",
    lambda s, d: table(s, d, "chunks").select(c("id").alias("chunk_id"), X.line_excerpt(c("content"), F.lit(2), F.lit(4)).alias("excerpt")))

put("x24_elided_source", None, lambda s, d: table(s, d, "chunks").select(c("id").alias("chunk_id"), F.length(udfs.elide("content")).cast("long").alias("n_chars")))

put("x25_reranker_document", """
SELECT c.id AS chunk_id, f.path || chr(10) || coalesce(c.kind, '') || ' ' || coalesce(c.name, '') || chr(10) || substr(c.content, 1, 400) AS document
FROM chunks c JOIN files f ON f.id = c.file_id""",
    lambda s, d: table(s, d, "chunks").join(table(s, d, "files").select(c("id").alias("fid"), "path"), c("file_id") == c("fid")).select(
        c("id").alias("chunk_id"), F.concat("path", F.lit("\n"), F.coalesce("kind", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")), F.lit("\n"), F.substring("content", 1, 400)).alias("document")))

put("x26_json_pointer", """
SELECT id, json_extract_string(body, '$.purpose') AS purpose, CAST(json_extract(body, '$.files') AS BIGINT) AS n_files FROM (SELECT DISTINCT id, body FROM artifact_views)""",
    lambda s, d: table(s, d, "artifact_views").select("id", "body").distinct().select(
        "id", F.get_json_object("body", "$.purpose").alias("purpose"), F.get_json_object("body", "$.files").cast("long").alias("n_files")))

put("x27_profile_fingerprint", """
SELECT id, sha256(concat(coalesce(provider, ''), chr(0), coalesce(model, ''), chr(0), dimensions::VARCHAR)) AS fingerprint FROM embedding_profiles""",
    lambda s, d: table(s, d, "embedding_profiles").select("id", X.digest(c("provider"), c("model"), c("dimensions")).alias("fingerprint")))

put("x28_anchors", r"""
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda t: regexp_matches(t, '[a-z][A-Z]')))), ' ') AS anchors FROM eval_items""",
    lambda s, d: table(s, d, "eval_items").select("item_id", F.array_join(F.array_sort(F.array_distinct(F.filter(
        F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), 1), lambda t: t.rlike("[a-z][A-Z]")))), " ").alias("anchors")))

put("x29_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b""",
    lambda s, d: (lambda e: e.crossJoin(F.broadcast(e.orderBy("vec_id").limit(1).select(c("embedding").alias("_q")))).select(
        "vec_id", X.round_score(X.cosine(c("embedding"), c("_q"))).alias("cosine")))(table(s, d, "embeddings")))

put("f14_identifier_containment", None, lambda s, d: table(s, d, "chunks").select(
    c("id").alias("chunk_id"), udfs.contains_identifier(c("content"), F.lit("log")).alias("mentions_log")))
