"""Search: BM25, exact tiers, nearest vectors, fusion, penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import retrieval as R
from ..operators import text_index as T
from ..session import published, table
from .registry import Registry

REG = Registry()
c = F.col
QUERY = ["digest", "migration", "index", "queue", "after"]
IN_QUERY = ", ".join(f"'{t}'" for t in QUERY)
TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_$]+')"


def put(name, sql, f):
    REG.add(name, sql)(f)


def _bm25_sql(rows: str, key: str, weights: dict[str, float]) -> str:
    """CTEs hits, sizes, stats and bm25(key, score) over relation ``rows``."""
    posts = " UNION ALL ".join(
        f"SELECT {key}, unnest({TERMS.format(col)}) AS term, {w} AS w FROM {rows}" for col, w in weights.items()
    )
    length = " + ".join(f"len({TERMS.format(f'coalesce({col}, {chr(39) * 2})')})" for col in weights)
    return f"""
hits AS (SELECT {key}, term, sum(w) AS tf FROM ({posts}) WHERE term IN ({IN_QUERY}) GROUP BY ALL),
sizes AS (SELECT {key}, {length} AS length FROM {rows}),
stats AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM sizes),
spread AS (SELECT term, count(*) AS n_with FROM hits GROUP BY 1),
bm25 AS (SELECT {key}, round(sum(greatest(ln((n_docs - n_with + 0.5) / (n_with + 0.5)), {T.IDF_FLOOR}) * tf * {T.K1 + 1}
  / (tf + {T.K1} * (1 - {T.B} + {T.B} * length / mean_length))), 6)::DOUBLE AS score
  FROM hits JOIN spread USING (term) JOIN sizes USING ({key}) CROSS JOIN stats GROUP BY 1)"""


_DOC_SQL = "WITH " + _bm25_sql("documents", "doc_id", {"text": 1.0})
_CHUNK_ROWS = "rows AS (SELECT c.id AS chunk_id, c.content, c.name, c.symbols, f.path, f.role, f.origin FROM chunks c JOIN files f ON f.id = c.file_id)"
_CHUNK_SQL = f"WITH {_CHUNK_ROWS}, " + _bm25_sql("rows", "chunk_id", T.CHUNK_WEIGHTS)


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select(c("id").alias("_f"), "path", "role", "origin")
    return table(spark, d, "chunks").join(files, c("file_id") == c("_f")).select(
        c("id").alias("chunk_id"), "file_id", "content", "name", "symbols", "path", "role", "origin", "start_byte", "start_line"
    )


def doc_ranking(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return R.top(documents_found(spark, d), [c("score").desc(), c("doc_id")], limit)


def _found(spark: SparkSession, d: str, name: str, rows, key: str, weights: dict[str, float]) -> DataFrame:
    """The query's documents from the text index of a table, which is published once an application."""
    entries = published(spark, d, f"postings-{name}", lambda: T.index(rows(), key, weights), ["term"])
    stats = published(spark, d, f"statistics-{name}", lambda: T.statistics(rows(), key, weights))
    return T.search(entries, stats, key, QUERY)


def documents_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "documents", lambda: table(spark, d, "documents"), "doc_id", {"text": 1.0})


def chunks_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "chunks", lambda: chunk_rows(spark, d), "chunk_id", T.CHUNK_WEIGHTS)


def chunk_ranking(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return R.top(chunks_found(spark, d), [c("score").desc(), c("chunk_id")], limit)


put("s15_postings", f"SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY 1",
    lambda s, d: T.postings(table(s, d, "documents"), "doc_id", {"text": 1.0}).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("tf").cast("long").alias("n")))

put("r1_bm25_documents", _DOC_SQL + " SELECT doc_id, score FROM bm25",
    lambda s, d: documents_found(s, d))

put("r1_bm25_chunks", _CHUNK_SQL + " SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm25 ORDER BY rank LIMIT 50",
    lambda s, d: chunk_ranking(s, d, 50))

_KNN = """v AS (SELECT vec_id, label, embedding FROM embeddings),
knn AS (SELECT v.vec_id, v.label, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine
  FROM v, (SELECT embedding FROM v ORDER BY vec_id LIMIT 1) q),
per AS (SELECT * FROM knn QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) <= {k})"""


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).select(c("embedding").alias("q"))


put("v1_exact_knn", "WITH " + _KNN.format(k=20) + " SELECT vec_id, label, cosine, row_number() OVER (ORDER BY cosine DESC, vec_id) AS rank FROM per ORDER BY rank LIMIT 20",
    lambda s, d: R.nearest(table(s, d, "embeddings"), "vec_id", "embedding", "label", _query_vector(s, d), 20))

_FUSED = "WITH " + _bm25_sql("documents", "doc_id", {"text": 1.0}) + ", " + _KNN.format(k=50) + """,
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 ORDER BY rank LIMIT 50),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY cosine DESC, vec_id) AS rank FROM per ORDER BY rank LIMIT 50),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1),
fused AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f ORDER BY rank LIMIT 60)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    words = doc_ranking(spark, d, 50).select(c("doc_id").alias("id"), "rank")
    near = R.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", "label", _query_vector(spark, d), 50)
    return R.reciprocal_rank_fusion([words, near.select(c("vec_id").alias("id"), "rank")], "id", 60)


put("r6_a12_reciprocal_rank_fusion", _FUSED + " SELECT id, score, rank FROM fused", fused)
put("a13_max_normalised", _FUSED + " SELECT id, round(score / (SELECT max(score) FROM fused), 6) AS score, rank FROM fused",
    lambda s, d: R.max_normalized(fused(s, d), "score"))

_PEN = "CASE role WHEN 'production' THEN 1.0 WHEN 'unknown' THEN 0.75 WHEN 'documentation' THEN 0.4 WHEN 'test' THEN 0.3 WHEN 'fixture' THEN 0.2 WHEN 'generated' THEN 0.1 ELSE CASE WHEN role IS NULL THEN 1.0 ELSE 0 END END"
put("r8_policy_penalty", _CHUNK_SQL + f""",
r AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS old_rank FROM bm25 ORDER BY old_rank LIMIT 50),
p AS (SELECT chunk_id, old_rank, round(({_PEN})::DOUBLE / old_rank, 9) AS penalty_score FROM r JOIN rows USING (chunk_id))
SELECT chunk_id, old_rank, penalty_score, row_number() OVER (ORDER BY penalty_score DESC, old_rank) AS rank FROM p ORDER BY rank LIMIT 30""",
    lambda s, d: R.penalized(
        chunk_ranking(s, d, 50).join(chunk_rows(s, d).select("chunk_id", "role"), "chunk_id"), "chunk_id", X.role_penalty(c("role")), 30
    ).select("chunk_id", "old_rank", "penalty_score", "rank"))

_NAMES = "SELECT name FROM chunks WHERE name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 5"


def _names(spark: SparkSession, d: str) -> DataFrame:
    """The five commonest names, as the identifiers asked for."""
    return table(spark, d, "chunks").filter("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(
        c("n").desc(), "name").limit(5).select(c("name").alias("identifier"))


_DEFS = f"""idents AS ({_NAMES}),
defs AS (SELECT c.id AS chunk_id, c.name AS identifier, row_number() OVER (PARTITION BY c.name ORDER BY
  CASE WHEN regexp_matches(c.content, '^\\s*export\\b') THEN 0 ELSE 1 END, c.end_byte - c.start_byte, f.path, c.start_byte, c.id) AS depth
  FROM chunks c JOIN files f ON f.id = c.file_id JOIN idents ON idents.name = c.name)"""


def definitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").join(table(spark, d, "files").select(c("id").alias("_f"), "path"), c("file_id") == c("_f"))
    hits = rows.join(F.broadcast(_names(spark, d)), c("name") == c("identifier"))  # five rows
    order = [F.when(c("content").rlike(r"^\s*export\b"), 0).otherwise(1), c("end_byte") - c("start_byte"), c("path"), c("start_byte"), c("id")]
    w = Window.partitionBy("identifier").orderBy(*order)
    return hits.select(c("id").alias("chunk_id"), "identifier", F.row_number().over(w).cast("long").alias("depth"))


put("r2_exact_definitions", f"WITH {_DEFS} SELECT chunk_id, identifier, depth FROM defs", definitions)
put("w6_r5_round_robin_tiers", f"WITH {_DEFS} SELECT chunk_id, identifier, depth, row_number() OVER (ORDER BY depth, identifier, chunk_id) AS position FROM defs",
    lambda s, d: definitions(s, d).withColumn("position", F.row_number().over(Window.orderBy("depth", "identifier", "chunk_id")).cast("long")))

_OCC_ONLY = """
occ AS (SELECT DISTINCT c.id AS chunk_id, idents.name AS identifier FROM chunks c JOIN idents
  ON list_contains(regexp_extract_all(c.content, '[A-Za-z0-9_$]+'), idents.name) AND coalesce(c.name, '') <> idents.name)"""
_OCC = f"idents AS ({_NAMES}), {_OCC_ONLY}"


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that mention an identifier and do not define it: an equi-join on the chunk's tokens."""
    tokens = table(spark, d, "chunks").select(c("id").alias("chunk_id"), "name", F.explode(F.array_distinct(X.identifier_tokens(c("content")))).alias("token"))
    hits = tokens.join(F.broadcast(_names(spark, d)), c("token") == c("identifier"))  # five rows
    return hits.filter(F.coalesce("name", F.lit("")) != c("identifier")).select("chunk_id", "identifier").distinct()


put("r3_exact_occurrences", f"WITH {_OCC} SELECT chunk_id, identifier FROM occ", occurrences)
put("r4_exact_intent", f"WITH {_DEFS}, {_OCC_ONLY} SELECT identifier, min(chunk_id) AS chunk_id FROM occ WHERE chunk_id NOT IN (SELECT chunk_id FROM defs) GROUP BY 1",
    lambda s, d: occurrences(s, d).join(definitions(s, d).select("chunk_id"), "chunk_id", "left_anti").groupBy("identifier").agg(F.min("chunk_id").alias("chunk_id")))

put("u7_r7_keep_first_merge", _CHUNK_SQL + """,
r AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm25 ORDER BY rank LIMIT 50),
pre AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id DESC) AS rank FROM r WHERE r.rank <= 10),
u AS (SELECT chunk_id, 0 AS list_no, rank FROM pre UNION ALL SELECT chunk_id, 1, rank FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY list_no, rank) AS n FROM u)
SELECT chunk_id, list_no::BIGINT AS list_no, rank FROM m WHERE n = 1""",
    lambda s, d: (lambda r: R.keep_first([
        r.filter("rank <= 10").select("chunk_id").withColumn("rank", F.row_number().over(Window.orderBy(c("chunk_id").desc()))), r], "chunk_id"))(chunk_ranking(s, d, 50)))

put("r9_hydration", _CHUNK_SQL + """,
r AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm25 ORDER BY rank LIMIT 10)
SELECT r.chunk_id, r.rank, rows.path, array_to_string(string_split(rows.content, chr(10))[1:4], chr(10)) AS snippet FROM r JOIN rows USING (chunk_id)""",
    lambda s, d: chunk_ranking(s, d, 10).join(chunk_rows(s, d), "chunk_id").select(
        "chunk_id", "rank", "path", F.array_join(F.slice(F.split("content", "\n"), 1, 4), "\n").alias("snippet")))

put("f7_role_filter_before_fusion", _CHUNK_SQL + """
SELECT b.chunk_id, b.score, row_number() OVER (ORDER BY b.score DESC, b.chunk_id) AS rank FROM bm25 b JOIN rows USING (chunk_id)
WHERE rows.role IN ('production', 'unknown') AND lower(trim(rows.origin)) IN ('repository', 'workspace') ORDER BY rank LIMIT 50""",
    lambda s, d: R.top(chunks_found(s, d).join(
        chunk_rows(s, d).filter(c("role").isin("production", "unknown") & F.lower(F.trim("origin")).isin("repository", "workspace")).select("chunk_id"),
        "chunk_id", "left_semi"), [c("score").desc(), c("chunk_id")], 50))

put("r10_hybrid_search", _FUSED + """ SELECT f.id, f.rank, f.score, substr(d.text, 1, 80) AS head FROM fused f LEFT JOIN documents d ON d.doc_id = f.id""",
    lambda s, d: fused(s, d).join(table(s, d, "documents").select(c("doc_id").alias("id"), F.substring("text", 1, 80).alias("head")), "id", "left").select(
        "id", "rank", "score", "head"))

put("r12_name_usage_count", r"""
WITH syms AS (SELECT DISTINCT name FROM chunks WHERE name IS NOT NULL),
toks AS (SELECT id, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z0-9_$]+'))) AS token FROM chunks)
SELECT name, count(*) AS n_chunks FROM syms JOIN toks ON token = name GROUP BY 1""",
    lambda s, d: table(s, d, "chunks").select(F.explode(F.array_distinct(X.identifier_tokens(c("content")))).alias("name")).join(
        table(s, d, "chunks").filter("name IS NOT NULL").select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n_chunks")))
