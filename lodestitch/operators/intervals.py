"""Joins of spans: containment, overlap and nearest following, within one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Units (bytes or lines) of the ranges that spans are joined by.
RANGE = 4096


def _ranges(start: Column, last: Column) -> Column:
    """Numbers of the ranges that a span touches, its last unit included; one for a span without units."""
    first = F.floor(start / RANGE)
    return F.sequence(first, F.greatest(first, F.floor(last / RANGE)))


def innermost(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, key: str, span_key: str, inclusive_end: bool = False) -> DataFrame:
    """For each point the narrowest span of its group that contains it; ties to the earlier start, then the lower key.

    An equi-join on group and range, so that a large file is no one key, then an aggregation that keeps one span per
    point on the map side. Spans without start or end, and points without a place, have no part.
    """
    s = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(span_key).alias("_k"), F.explode(_ranges(F.col(start), F.col(end))).alias("_r"))
    inside = (F.col(at) >= F.col("_s")) & ((F.col(at) <= F.col("_e")) if inclusive_end else (F.col(at) < F.col("_e")))
    hits = points.select(group, key, at, F.floor(F.col(at) / RANGE).alias("_pr")).join(s, (F.col(group) == F.col("_g")) & (F.col("_pr") == F.col("_r")) & inside)
    best = hits.groupBy(key).agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("width"), "_s", "_k")).alias("_b"))
    return best.select(key, F.col("_b._k").alias("container"), F.col("_b.width").alias("width"))


def overlapping(left: DataFrame, right: DataFrame, group: str, start: str, end: str, left_key: str, right_key: str, inclusive: bool = False) -> DataFrame:
    """Pairs of spans of one group that overlap, half-open or (``inclusive``) closed.

    Spans meet by group and range, in the first range both touch, so each pair comes once and a group with very many
    spans is spread over its ranges. Spans without start or end overlap nothing.
    """
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    a = left.filter(known).select(group, F.col(start).alias("_ls"), F.col(end).alias("_le"), F.col(left_key).alias("left_key"), F.explode(_ranges(F.col(start), F.col(end))).alias("_r"))
    r = right.filter(known).select(
        F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(right_key).alias("right_key"), F.explode(_ranges(F.col(start), F.col(end))).alias("_rr"))
    if inclusive:
        meet = (F.col("_ls") <= F.col("_e")) & (F.col("_le") >= F.col("_s"))
    else:
        meet = (F.col("_ls") < F.col("_e")) & (F.col("_le") > F.col("_s"))
    first = F.col("_r") == F.floor(F.greatest("_ls", "_s") / RANGE)
    return a.join(r, (F.col(group) == F.col("_g")) & (F.col("_r") == F.col("_rr")) & first & meet).select(group, "left_key", "right_key")


def next_within(points: DataFrame, targets: DataFrame, group: str, at: str, start: str, key: str, target_key: str, reach: int) -> DataFrame:
    """For each point the first target of its group that starts at or after it, at most ``reach`` further on."""
    t = targets.select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(target_key).alias("_k"))
    near = (F.col("_s") >= F.col(at)) & (F.col("_s") - F.col(at) <= reach)
    hits = points.select(group, key, at).join(t, (F.col(group) == F.col("_g")) & near)
    best = hits.groupBy(key).agg(F.min(F.struct("_s", "_k")).alias("_b"))
    return best.select(key, F.col("_b._k").alias("target"), F.col("_b._s").alias("target_start"))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, key: str, root: str, root_key: str) -> DataFrame:
    """For each path the deepest root it lies under, by folder.

    Each path is expanded to its ancestor folders (as many as it has), which makes the prefix test an equi-join.
    """
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = paths.select(key, F.posexplode(ups).alias("_depth", "_folder"))
    r = roots.select(F.col(root).alias("_root"), F.col(root_key).alias("_rk"))
    hits = ancestors.join(r, F.col("_folder") == F.col("_root"))
    w = Window.partitionBy(key).orderBy(F.col("_depth").desc(), "_rk")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, F.col("_rk").alias("owner"), F.col("_root").alias("root"))
