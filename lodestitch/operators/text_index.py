"""Full-text index as relations, and BM25 ranking over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import search_terms

#: BM25 parameters and the floor of the inverse document frequency (fixed values).
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Weights of the columns of a chunk (fixed values).
CHUNK_WEIGHTS = {"content": 2.0, "name": 4.0, "symbols": 3.0, "path": 1.0}


def postings(docs: DataFrame, key: str, weights: dict[str, float], terms: list[str] | None = None) -> DataFrame:
    """(key, term, tf) with tf the column-weighted number of occurrences; null columns have no terms.

    With ``terms`` only these are kept, before anything is shuffled: a query needs no other postings.
    """
    parts = []
    for column, weight in weights.items():
        one = docs.select(F.col(key), F.explode(search_terms(F.col(column))).alias("term"), F.lit(weight).alias("w"))
        parts.append(one if terms is None else one.filter(F.col("term").isin(terms)))
    return reduce(DataFrame.unionByName, parts).groupBy(key, "term").agg(F.sum("w").alias("tf"))


def lengths(docs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, length) with length the number of terms over all columns."""
    n = reduce(lambda a, b: a + b, [F.greatest(F.size(search_terms(F.coalesce(F.col(c), F.lit("")))), F.lit(0)) for c in weights])
    return docs.select(F.col(key), n.cast("long").alias("length"))


def idf(n_docs: Column, n_with: Column) -> Column:
    """Inverse document frequency, floored for terms in more than half of the documents."""
    return F.greatest(F.log((n_docs - n_with + 0.5) / (n_with + 0.5)), F.lit(IDF_FLOOR))


def index(docs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(term, key, tf, length): postings with the document's length beside them, to be published sorted by term."""
    return postings(docs, key, weights).join(lengths(docs, key, weights), key).select("term", key, "tf", "length")


def statistics(docs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """One row: n_docs and mean_length of the collection."""
    return lengths(docs, key, weights).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))


def search(entries: DataFrame, stats: DataFrame, key: str, query: list[str]) -> DataFrame:
    """(key, score) of every document with a query term, from a stored ``index`` and its ``statistics``; greater is
    better. Terms of the query are lower case and count once; only their postings are read."""
    hits = entries.filter(F.col("term").isin(sorted(set(query))))
    spread = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_with"))  # a row for each query term
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    part = idf(F.col("n_docs"), F.col("n_with")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    scored = hits.join(F.broadcast(spread), "term").crossJoin(F.broadcast(stats))  # one row
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def bm25(docs: DataFrame, key: str, query: list[str], weights: dict[str, float]) -> DataFrame:
    """(key, score) as ``search`` gives them, for documents (``key`` unique) without a stored index: only the query's
    postings are aggregated."""
    hits = postings(docs, key, weights, sorted(set(query))).join(lengths(docs, key, weights), key)
    return search(hits, statistics(docs, key, weights), key, query)
