"""Queries of the training-data operators over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.registry import Registry
from ..session import table
from . import encodings, handwritten, leakage, packing, rank_fusion, similar_vectors, splitting, syntax, tokens

REG = Registry()

SCORES = ["lexical_score", "vector_cosine", "rank_score"]


def _limits_sql(letters: str) -> str:
    return f"regexp_replace(regexp_replace(lower({letters}), '[^a-z]', '', 'g'), 's$', '')"


@REG.add("p4_found", f"""
SELECT c.id AS chunk_id FROM chunks c JOIN split_limits l ON {_limits_sql('c.kind')} = {_limits_sql('l.kind')}
WHERE strlen(c.content) > l.max_bytes""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).filter(F.col("piece") == 0).select("chunk_id")


@REG.add("p4_pieces")
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_limits"))


@REG.add("p6_found", """
WITH s AS (SELECT DISTINCT query_id, artifact_id, coalesce(lexical_score, -1e300) AS a, coalesce(vector_cosine, -1e300) AS b,
  coalesce(rank_score, -1e300) AS c FROM artifact_scores)
SELECT query_id, artifact_id FROM s x WHERE NOT EXISTS (
  SELECT 1 FROM s y WHERE y.query_id = x.query_id AND y.artifact_id <> x.artifact_id
  AND sign(x.a - y.a) + sign(x.b - y.b) + sign(x.c - y.c) <= 0)""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = p6_ranking(spark, sf_dir)
    return rank_fusion.ahead_of_all(spark, ranking, "query_id", "artifact_id", SCORES)


_RRA_RANK = """(count(*) OVER (PARTITION BY query_id) - (count(*) OVER (PARTITION BY query_id ORDER BY coalesce({0}, -1e300)))
  + (count(*) OVER (PARTITION BY query_id, {0}) + 1) / 2.0) / count(*) OVER (PARTITION BY query_id)"""


@REG.add("p6_ranking", f"""
WITH s AS (SELECT DISTINCT query_id, artifact_id, lexical_score, vector_cosine, rank_score FROM artifact_scores),
r AS (SELECT *, {_RRA_RANK.format('lexical_score')} AS r1, {_RRA_RANK.format('vector_cosine')} AS r2,
  {_RRA_RANK.format('rank_score')} AS r3 FROM s),
o AS (SELECT *, list_sort([r1, r2, r3]) AS l FROM r),
b AS (SELECT *, round(least(1.0, 3 * least(1 - pow(1 - l[1], 3), 3 * l[2] * l[2] * (1 - l[2]) + pow(l[2], 3), pow(l[3], 3))), 12)
  AS rho, round((r1 + r2 + r3) / 3, 12) AS mean_rank FROM o)
SELECT query_id, artifact_id, lexical_score, vector_cosine, rank_score, round(rho, 6) AS rho, round(mean_rank, 6) AS mean_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY rho, mean_rank, artifact_id) AS position FROM b""")
def p6_ranking_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = p6_ranking(spark, sf_dir)
    return ranking.drop("n_items").withColumns({c: F.round(c, 6) for c in ("rho", "mean_rank")})


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.robust_rank(spark, table(spark, sf_dir, "artifact_scores"), "query_id", "artifact_id", SCORES)


#: Tokens a container holds.
CAPACITY = 4096


@REG.add("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.with_token_count(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(spark, sizes, "doc_id", "n_tokens", CAPACITY)


@REG.add("p7_summary")
def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.with_token_count(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.fill_summary(spark, sizes, "doc_id", "n_tokens", CAPACITY)


@REG.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).select("doc_id", "item_id").distinct()


@REG.add("p8_passages")
def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@REG.add("p8_items")
def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p8_passages(spark, sf_dir)
    return found.groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest")
    )


@REG.add("p8_cleaned")
def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@REG.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = encodings.damaged_words(spark, table(spark, sf_dir, "documents"))
    return encodings.damaged_documents(hits).select("doc_id")


@REG.add("p9_evidence")
def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.evidence(encodings.damaged_words(spark, table(spark, sf_dir, "documents")))


@REG.add("p9_restored")
def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encodings.restored(docs, encodings.damaged_words(spark, docs))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "source_files"))


@REG.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).filter(~F.col("valid")).select("file_id")


@REG.add("p2_errors")
def p2_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hinted = syntax.with_hints(_checked(spark, sf_dir), table(spark, sf_dir, "files"), table(spark, sf_dir, "walk_rejections"))
    return hinted.filter(~F.col("valid") | F.col("logged")).select(
        "file_id", "language", "valid", "n_errors", "first_line", "first_cause", "logged"
    )


@REG.add("p2_rates")
def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(_checked(spark, sf_dir), table(spark, sf_dir, "files"))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.usable_vectors(table(spark, sf_dir, "semantic_embeddings"), table(spark, sf_dir, "embedding_profiles"))


#: A pair counts as found from this cosine on.
NEAR = 0.9


@REG.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors.similar_vectors(spark, _unit(spark, sf_dir), k=10, least=NEAR)
    return near.select(
        F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")
    ).distinct()


@REG.add("p5_neighbours")
def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    # asked about is every id divisible by 50, against all rows
    return similar_vectors.similar_vectors(spark, _unit(spark, sf_dir), k=10, recall=0.95, asked=F.col("vec_id") % 50 == 0)


@REG.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_files(spark, sf_dir).filter("found").select("file_id")


@REG.add("p3_files")
def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.machine_written(spark, table(spark, sf_dir, "files"), table(spark, sf_dir, "source_files"))
