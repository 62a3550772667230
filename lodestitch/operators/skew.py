"""Joins and ranks that stay distributed when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: A key is hot when it holds more than this share of the rows; so at most 256 keys can be hot.
HOT_SHARE = 1 / 256
#: Keys with fewer rows than this are never treated as hot.
HOT_FLOOR = 20_000


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that hold more than HOT_SHARE of the rows; at most 1/HOT_SHARE of them.

    Counting combines on the map side, so the shuffle carries one row per key and task.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(HOT_FLOOR, total * HOT_SHARE)
    if total < least:
        return []
    return [r[0] for r in counts.filter(F.col("_n") > least).select(key).collect()]


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` with ``right``, whose ``right_key`` is unique; ``how`` is inner or left.

    Rows of hot keys are joined with a broadcast of just those keys' rows (at most 256), the rest by the
    ordinary join, so that no task receives a whole hot key. Column names must not clash.
    """
    return _joined(left, right, left_key, right_key, how, hot_keys(left, left_key))


def _joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, hot: list) -> DataFrame:
    on = F.col(left_key) == F.col(right_key)
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(left_key).isin(hot), F.lit(False))
    few = F.broadcast(right.filter(F.col(right_key).isin(hot)))
    return left.filter(is_hot).join(few, on, how).unionByName(left.filter(~is_hot).join(right, on, how))


def ranked(
    spark: SparkSession, df: DataFrame, group: str, order: list[Column], names: list[str], tag: str = "rank", weight: str | None = None
) -> tuple[DataFrame, Scratch]:
    """Position of each distinct (group, order key) in its group without gathering a group in a task.

    ``order`` are the sort expressions over columns ``names``. Returns one row per (group, names) with
    ``n`` (rows with that key), ``before`` (rows of the group sorted before it) and ``total``. The keys are
    range-partitioned over the whole table, positions inside a partition come from a window, and the
    partitions' offsets (at most groups + partitions rows) are added. With ``weight`` (a column) rows count by it.
    """
    scratch = Scratch(spark, tag)
    keys = df.groupBy(group, *names).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    parted = scratch.keep(
        keys.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = parted.groupBy(group, "_part").agg(F.sum("n").alias("_size"))
    over_parts = Window.partitionBy(group).orderBy("_part")
    offsets = sizes.select(
        F.col(group).alias("_g"),
        F.col("_part").alias("_p"),
        (F.sum("_size").over(over_parts) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(group)).alias("total"),
    )
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.withColumn("_upto", F.sum("n").over(inside))
    out = local.join(
        offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")), "inner"
    ).select(group, *names, "n", (F.col("_offset") + F.col("_upto") - F.col("n")).alias("before"), "total")
    return out, scratch


def with_ranks(
    spark: SparkSession, df: DataFrame, group: list[str], values: list[str], order: list[Column], tag: str = "rank"
) -> DataFrame:
    """``df`` with n, before and total: how many rows of its group have the row's ``values``, how many come before
    them by ``order`` (over ``values``), and the group's rows.

    Rows are range-partitioned by group and order, those of one value further by a hash of the row, so that neither a
    hot group nor a hot value is gathered; positions are counted inside each partition, and what goes on over a
    partition's end is mended by a table of at most two rows a partition. One shuffle, and a table written once.
    """
    scratch = Scratch(spark, tag)
    keyed = df.withColumns({"_gk": F.xxhash64(*group), "_vk": F.xxhash64(*group, *values)})
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    parted = keyed.repartitionByRange(*[F.col(g) for g in group], *order, spread).sortWithinPartitions(*[F.col(g) for g in group], *order)
    kinds = ", ".join(f"`{n}` {k}" for n, k in keyed.dtypes)
    local = scratch.keep(parted.mapInPandas(_local_ranks, f"{kinds}, _part int, _mark boolean, _n long, _before long, _size long"))
    offsets, ties = _across([tuple(r) for r in local.filter("_mark").select("_part", "_gk", "_vk", "_n", "_before", "_size").collect()])
    over = spark.createDataFrame(offsets, "_op int, _og long, _offset long, _total long")
    tied = spark.createDataFrame(ties, "_tp int, _tv long, _tn long, _tb long")
    out = local.join(F.broadcast(over), (F.col("_part") == F.col("_op")) & (F.col("_gk") == F.col("_og")), "left").join(
        F.broadcast(tied), (F.col("_part") == F.col("_tp")) & (F.col("_vk") == F.col("_tv")), "left")
    return out.select(
        *df.columns, F.coalesce("_tn", "_n").alias("n"), F.coalesce(F.col("_tb"), F.coalesce("_offset", F.lit(0)) + F.col("_before")).alias("before"),
        F.coalesce("_total", "_size").alias("total"),
    )


def _local_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition with run length, rows of the group before the run and group size, all within the
    partition; _mark is on the first row of the first and of the last run."""
    frames = [pdf for pdf in batches if len(pdf)]
    if not frames:
        return
    g, v = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("_gk", "_vk"))
    at = np.arange(len(g))
    starts = lambda x: np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    groups, runs = starts(g), starts(v)
    of_group, of_run = np.searchsorted(groups, at, side="right") - 1, np.searchsorted(runs, at, side="right") - 1
    size, length = np.diff(np.append(groups, len(g))), np.diff(np.append(runs, len(g)))
    mark = np.zeros(len(g), dtype=bool)
    mark[[runs[0], runs[-1]]] = True
    part, lo = TaskContext.get().partitionId(), 0
    for f in frames:
        k = slice(lo, lo + len(f))
        yield f.assign(_part=part, _mark=mark[k], _n=length[of_run[k]], _before=runs[of_run[k]] - groups[of_group[k]], _size=size[of_group[k]])
        lo += len(f)


def _across(marks: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """What marked runs (part, group, value, n, before, size) say about groups and runs in several partitions:
    (part, group, offset, total) and (part, value, n, before)."""
    sizes: dict[int, dict[int, int]] = {}
    for part, g, _, _, _, size in marks:
        sizes.setdefault(g, {})[part] = size
    offset, offsets = {}, []
    for g, parts in sizes.items():
        upto = 0
        for part in sorted(parts):
            offset[part, g] = upto
            upto += parts[part]
        if len(parts) > 1:
            offsets += [(part, g, offset[part, g], upto) for part in parts]
    runs: dict[int, dict[int, tuple[int, int]]] = {}
    for part, g, v, n, before, _ in marks:
        runs.setdefault(v, {})[part] = (n, offset[part, g] + before)
    ties = [(part, v, sum(n for n, _ in at.values()), min(b for _, b in at.values())) for v, at in runs.items() if len(at) > 1 for part in at]
    return offsets, ties


def positions(spark: SparkSession, df: DataFrame, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """(columns, position) of rows that ``columns`` identify, numbered from 1 over the whole table.

    A global row number without gathering the table in one task, as a window without partitions would.
    """
    keyed = df.select(F.lit(0).alias("_all"), *columns)
    at, _ = ranked(spark, keyed, "_all", order or [F.col(x) for x in columns], columns, "positions")
    return at.select(*columns, (F.col("before") + 1).cast("long").alias("position"))
