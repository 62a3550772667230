"""Ranking, fusion and merging of retrieval lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from .skew import positions

RRF_K = 60


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank; a distributed top-k before the one window over what is left."""
    best = df.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their rank."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= limit)


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """(key, score, rank) from lists of (key, rank): the sum of 1 / (k + rank); ties by key."""
    union = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    fused = union.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top(fused, [F.col("score").desc(), F.col(key)], limit)


def max_normalized(df: DataFrame, score: str) -> DataFrame:
    """The score divided by the greatest one, as one broadcast row."""
    most = df.agg(F.max(score).alias("_most"))
    return df.crossJoin(F.broadcast(most)).withColumn(score, F.round(F.col(score) / F.col("_most"), 6)).drop("_most")


def penalized(ranked: DataFrame, key: str, penalty: Column, limit: int) -> DataFrame:
    """Re-rank by penalty / rank, ties by the old rank."""
    scored = ranked.withColumn("penalty_score", F.round(penalty / F.col("rank"), 9)).withColumnRenamed("rank", "old_rank")
    return top(scored, [F.col("penalty_score").desc(), F.col("old_rank")], limit)


def keep_first(lists: list[DataFrame], key: str) -> DataFrame:
    """(key, list_no, rank): ordered union of ranked lists in which a key keeps its first place."""
    union = reduce(DataFrame.unionByName, [x.select(key, F.lit(n).cast("long").alias("list_no"), F.col("rank").cast("long").alias("rank")) for n, x in enumerate(lists)])
    first = union.groupBy(key).agg(F.min(F.struct("list_no", "rank")).alias("_f"))
    return first.select(key, "_f.list_no", "_f.rank")


def round_robin(spark: SparkSession, df: DataFrame, key: str, group: str, order: list[Column]) -> DataFrame:
    """(key, group, depth, position): first of each group, then second of each ..., groups and keys ascending.

    ``depth`` is the place in the group by ``order``; ``key`` is unique.
    """
    depth = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    return positions(spark, df.withColumn("depth", depth), ["depth", group, key])


def nearest(vectors: DataFrame, key: str, vector: str, partition: str, query: DataFrame, k: int) -> DataFrame:
    """(key, partition, cosine, rank): exact nearest neighbours of the one vector of ``query`` (column q).

    The best k of each partition value, merged and cut to k; ties by key. The query is one broadcast row.
    """
    scored = vectors.crossJoin(F.broadcast(query)).select(key, partition, F.round(cosine(F.col(vector), F.col("q")), 6).alias("cosine"))
    scored = scored.filter(F.col("cosine").isNotNull())
    per = top_per_group(scored, [partition], [F.col("cosine").desc(), F.col(key)], k).drop("rank")
    return top(per, [F.col("cosine").desc(), F.col(key)], k)
