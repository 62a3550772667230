"""One ranking from several differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup_join, with_ranks
from ..session import Scratch

#: Rows folded into one champion at a time when looking for the item ahead of all others.
BLOCK = 512


def _clean(c: str) -> Column:
    """Scores as doubles; NaN counts as null."""
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def _choose(n: int, k: int) -> int:
    return reduce(lambda a, i: a * (n - i) // (i + 1), range(k), 1)


def _beta(r: Column, k: int, m: int) -> Column:
    """Probability that the k-th smallest of m uniform ranks is at most r."""
    terms = [F.lit(_choose(m, j)) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(k, m + 1)]
    return reduce(lambda a, b: a + b, terms)


def robust_rank(spark: SparkSession, df: DataFrame, query: str, item: str, scores: list[str]) -> DataFrame:
    """Robust rank aggregation of ``scores`` (higher is better) per ``query``.

    Each score becomes a normalised mean rank in (0, 1]; a null or NaN score ranks below all values. An item's
    ranks are sorted, the beta probability of each order statistic is taken, and the least one times the number
    of scores, at most 1, is the item's ``rho``. Items are ranked by rho, then by mean rank, then by item, all
    ascending, so the ranking depends on no score's range or outliers.

    Repeated (query, item, scores) rows count once; if one item comes with several score tuples, the greatest
    tuple counts. Rows with a null query or item are dropped. Other columns are ignored. Groups are ranked over
    range partitions, so a query may hold any share of the rows.

    Result: query, item, the scores, rho, mean_rank, position (1 is best), n_items (of the query).
    """
    base = (
        df.filter(F.col(query).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(query).alias("_q"), F.col(item).alias("_i"))
        .agg(F.max(F.struct(*[_clean(c).alias(f"_s{k}") for k, c in enumerate(scores)])).alias("_s"))
        .select("_q", "_i", "_s.*")
    )
    scratch = Scratch(spark, "fusion")
    rows = scratch.keep(base)
    names = [f"_s{k}" for k in range(len(scores))]
    # one row per score, so that all scores are ranked by one range partitioning
    each = rows.select("_q", "_i", F.posexplode(F.array(*names)).alias("_k", "_v"))
    placed = with_ranks(spark, each, ["_q", "_k"], ["_v"], [F.col("_v").desc_nulls_last()], "fusion-ranks")
    mean = (F.col("before") + (F.col("n") + 1) / 2) / F.col("total")
    of = lambda k, x: F.max(F.when(F.col("_k") == k, x))
    rows = placed.groupBy("_q", "_i").agg(
        F.max("total").alias("n_items"), *[of(k, F.col("_v")).alias(c) for k, c in enumerate(names)], *[of(k, mean).alias(f"_r{k}") for k in range(len(names))]
    )
    m = len(names)
    sorted_ranks = F.array_sort(F.array(*[F.col(f"_r{k}") for k in range(m)]))
    rows = rows.withColumn("_sorted", sorted_ranks)
    least = F.least(*[_beta(F.col("_sorted")[k - 1], k, m) for k in range(1, m + 1)]) if m > 1 else _beta(F.col("_sorted")[0], 1, 1)
    rho = F.round(F.least(F.lit(1.0), least * m), 12)
    mean_rank = F.round(reduce(lambda a, b: a + b, [F.col(f"_r{k}") for k in range(m)]) / m, 12)
    scored = scratch.keep(rows.select("_q", "_i", *names, "n_items", rho.alias("rho"), mean_rank.alias("mean_rank")))
    order = [F.col("rho"), F.col("mean_rank"), F.col("_i")]
    out = with_ranks(spark, scored, ["_q"], ["rho", "mean_rank", "_i"], order, "fusion-places").withColumn("position", F.col("before") + 1)
    return out.select(
        F.col("_q").alias(query), F.col("_i").alias(item), *[F.col(n).alias(c) for n, c in zip(names, scores)],
        "rho", "mean_rank", "position", "n_items",
    )


def _ahead(a: Column, b: Column, scores: list[str]) -> Column:
    """Whether struct a is higher than struct b in more scores than it is lower; null is below any value."""

    def sign(c: str) -> Column:
        x, y = a[c], b[c]
        return (
            F.when(x.isNull() & y.isNull(), 0).when(y.isNull(), 1).when(x.isNull(), -1)
            .when(x > y, 1).when(x < y, -1).otherwise(0)
        )

    return reduce(lambda p, q: p + q, [sign(c) for c in scores]) > 0


def ahead_of_all(spark: SparkSession, ranking: DataFrame, query: str, item: str, scores: list[str]) -> DataFrame:
    """(query, item): the item of each query that is ahead of every other one in most scores, if any.

    ``ranking`` is the result of ``robust_rank``, which decides who can be it: an item ahead of each of the n - 1
    others is higher in more scores than it is lower against each, so the sum of its normalised ranks over the m
    scores is at most ((m - 1) n + m + 1) / 2n; all other items are out. Of those left, blocks of neighbours in the
    ranking are folded to one champion each, champions again until one is left; an item ahead of all others wins each
    fold it takes part in. The last one is then checked against all rows of its query. The only item of a query is
    ahead of all others.
    """
    scratch = Scratch(spark, "champion")
    rows = scratch.keep(
        ranking.select(F.col(query).alias("_q"), F.col("position").alias("_p"), F.col(item).alias("_i"), *scores, "mean_rank", "n_items")
    )
    m, n = len(scores), F.col("n_items")
    most = ((m - 1) * n + m + 1) / (2 * m * n)
    champions = rows.filter(F.col("mean_rank") <= most + 1e-9).select("_q", "_p", "_i", *scores)
    while True:
        champions = scratch.keep(_fold(champions, scores))
        if (champions.agg(F.max("_p")).first()[0] or 1) <= 1:
            break
    best = champions.select(F.col("_q").alias("_bq"), F.struct("_i", *scores).alias("_best"))
    beaten = F.when(F.col("_best._i") == F.col("_i"), True).otherwise(_ahead(F.col("_best"), F.struct("_i", *scores), scores))
    return (
        lookup_join(rows.select("_q", "_i", *scores), best, "_q", "_bq")
        .groupBy("_q").agg(F.bool_and(beaten).alias("_all"), F.any_value("_best._i").alias(item))
        .filter("_all").select(F.col("_q").alias(query), item)
    )


def _fold(rows: DataFrame, scores: list[str]) -> DataFrame:
    block = F.floor((F.col("_p") - 1) / BLOCK) + 1
    items = F.array_sort(F.collect_list(F.struct("_p", "_i", *scores)))
    won = F.aggregate(
        F.slice("_items", 2, BLOCK), F.col("_items")[0], lambda best, x: F.when(_ahead(x, best, scores), x).otherwise(best)
    )
    folded = rows.groupBy("_q", block.alias("_b")).agg(items.alias("_items")).select("_q", "_b", won.alias("_w"))
    return folded.select("_q", F.col("_b").alias("_p"), "_w._i", *[F.col(f"_w.{c}").alias(c) for c in scores])
