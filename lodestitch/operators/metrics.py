"""Retrieval and evaluation metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit_rates(ranks: DataFrame, rank: str, cuts: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """hit@k for each cut and the mean reciprocal rank; a null rank is a miss."""
    hits = [F.round(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in cuts]
    return ranks.agg(*hits, F.round(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), 6).alias("mrr"))


def set_precision(predicted: Column, gold: Column) -> Column:
    """Share of predicted items that are gold; nothing predicted is right only if nothing is gold."""
    common = F.size(F.array_intersect(predicted, gold))
    return F.when(F.size(predicted) == 0, (F.size(gold) == 0).cast("double")).otherwise(common / F.size(F.array_distinct(predicted)))


def set_recall(predicted: Column, gold: Column) -> Column:
    """Share of gold items that are predicted; 1 if nothing is gold."""
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(predicted, gold)) / F.size(F.array_distinct(gold)))


def percentiles(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """Three percentiles that differ: interpolated median, the value at floor(p (n - 1)) and the nearest rank
    ceil(p n), the last only for groups of 20 or more. Nulls do not count."""
    w = Window.partitionBy(group).orderBy(value)
    placed = df.filter(F.col(value).isNotNull()).select(
        group, value, (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("_n")
    )
    lower = F.max(F.when(F.col("_i") == F.floor(p * (F.col("_n") - 1)), F.col(value)))
    nearest = F.max(F.when((F.col("_i") == F.ceil(p * F.col("_n")) - 1) & (F.col("_n") >= 20), F.col(value)))
    return placed.groupBy(group).agg(
        F.round(F.percentile(value, F.lit(0.5)), 6).alias("median"), F.round(lower, 6).alias("lower_index"), F.round(nearest, 6).alias("nearest_rank")
    )


def lcg(seed: int) -> Iterator[float]:
    """Numbers in [0, 1) of a linear congruential generator modulo 2^32."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (1664525 * state + 1013904223) & 0xFFFFFFFF
        yield state / 2**32


def bootstrap(clusters: list[list[float]], iterations: int = 10_000, seed: int = 1) -> tuple[float, float]:
    """2.5th and 97.5th percentile (lower index) of the mean over resampled clusters."""
    if not clusters:
        return (float("nan"), float("nan"))
    random = lcg(seed)
    means = []
    for _ in range(iterations):
        values = [v for _ in clusters for v in clusters[int(next(random) * len(clusters))]]
        means.append(sum(values) / len(values))
    means.sort()
    at = lambda p: means[int(p * (len(means) - 1))]
    return at(0.025), at(0.975)


def bootstrap_intervals(df: DataFrame, group: str, cluster: str, value: str, iterations: int = 10_000) -> DataFrame:
    """(group, low, high) of a cluster bootstrap in each group.

    The clusters' sums and counts are aggregated first, so a task receives one row per cluster of its group.
    """
    per = df.groupBy(group, cluster).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n")).filter("_n > 0")
    kind = df.schema[group].dataType.simpleString()

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        sums, counts, n = pdf["_sum"].tolist(), pdf["_n"].tolist(), len(pdf)
        sums, counts = np.array(sums, dtype=float), np.array(counts, dtype=float)
        # the numbers of lcg, n at a time: the k-th after a state is factor[k] * state + shift[k]
        factor, shift, a, b = np.empty(n, np.uint64), np.empty(n, np.uint64), 1, 0
        for k in range(n):
            a, b = 1664525 * a & 0xFFFFFFFF, 1664525 * b + 1013904223 & 0xFFFFFFFF
            factor[k], shift[k] = a, b
        state, means = np.uint64(1), []
        for _ in range(iterations):
            states = factor * state + shift & np.uint64(0xFFFFFFFF)
            picks, state = (states.astype(float) / 2**32 * n).astype(np.int64), states[-1]
            means.append(float(sums[picks].sum() / counts[picks].sum()))
        means.sort()
        return pd.DataFrame({group: [pdf[group].iloc[0]], "low": [round(means[int(0.025 * (iterations - 1))], 6)], "high": [round(means[int(0.975 * (iterations - 1))], 6)]})

    return per.groupBy(group).applyInPandas(resample, f"{group} {kind}, low double, high double")
