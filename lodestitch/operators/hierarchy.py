"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .skew import HOT_FLOOR, lookup_join, ranked


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per non-null ``key``: the greatest by ``order`` (nulls lowest), ties by ``columns``.

    An aggregation with map-side combine, so a key repeated in a third of all rows costs no more than another.
    """
    top = F.max(F.struct(*[F.col(c) for c in dict.fromkeys([*order, *columns])])).alias("_top")
    rows = df.filter(F.col(key).isNotNull()).groupBy(key).agg(top)
    return rows.select(key, *[F.col(f"_top.{c}").alias(c) for c in columns])


def parent_links(nodes: DataFrame, up: str = "supersedes", down: str = "superseded_by") -> DataFrame:
    """(id, parent) of nodes with unique ``id``: the node ``up`` names if it exists, else the node whose
    ``down`` names this one (the least id if several do), else null. Links to missing nodes are dropped."""
    ids = nodes.select(F.col("id").alias("_pid"))
    direct = lookup_join(nodes.select("id", up), ids, up, "_pid", "left").select("id", F.col("_pid").alias("_direct"))
    reverse = (
        nodes.filter(F.col(down).isNotNull())
        .groupBy(F.col(down).alias("_cid"))
        .agg(F.min("id").alias("_reverse"))
    )
    return direct.join(reverse, F.col("id") == F.col("_cid"), "left").select(
        "id", F.coalesce("_direct", "_reverse").alias("parent")
    )


def resolve_hierarchy(spark: SparkSession, links: DataFrame, paths: bool = False) -> DataFrame:
    """Root, depth and (with ``paths``) the path of every node of ``links`` (id unique, parent or null).

    Pointer doubling: each node holds an ancestor and its distance. A round joins the unfinished nodes with
    their ancestors' pointers, which doubles the distance; with ``paths`` the segment below the ancestor is
    concatenated. All depths up to the greatest occur, so a round that finishes no node proves that the rest
    are in or below a cycle; rounds are logarithmic in the depth. Parents must be ids of ``links``.

    Result: id, parent, root_id, depth, in_cycle and, with ``paths``, path (array from the root to the node;
    null for nodes in or below a cycle). root_id and depth are -1 for those. Empty input gives no rows; a node
    that is its own parent is a cycle. Other columns of ``links`` are ignored.
    """
    scratch = Scratch(spark, "hierarchy")
    seg = F.array("id") if paths else F.lit(None).cast("array<bigint>")
    start = scratch.keep(
        links.select(
            F.col("id").cast("long").alias("id"),
            F.col("parent").cast("long").alias("parent"),
            F.coalesce("parent", "id").cast("long").alias("ptr"),
            F.col("parent").isNotNull().cast("long").alias("dist"),
            F.col("parent").isNull().alias("done"),
        ).withColumn("seg", F.when(~F.col("done") | F.lit(paths), seg))
    )
    done, active, left = [start.filter("done")], start.filter("NOT done"), HOT_FLOOR + 1
    while True:
        known = reduce(DataFrame.unionByName, [*done, active]).select(
            F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"),
            F.col("done").alias("_done"), F.col("seg").alias("_seg"),
        )
        # fewer rows than a hot key would have need no search for one
        met = lookup_join(active, known, "ptr", "_id") if left > HOT_FLOOR else active.join(known, F.col("ptr") == F.col("_id"))
        joined = met.select(
            "id", "parent", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"),
            F.col("_done").alias("done"), F.concat("_seg", "seg").alias("seg"),
        )
        round_ = scratch.keep(joined)
        finished, left = round_.agg(
            F.count_if("done"), F.count_if(~F.col("done"))
        ).first()
        if finished:
            done.append(round_.filter("done"))
        active = round_.filter("NOT done")
        if not finished or not left:
            break
    good = reduce(DataFrame.unionByName, done).select(
        "id", "parent", F.col("ptr").alias("root_id"), F.col("dist").alias("depth"), F.lit(False).alias("in_cycle"),
        F.col("seg").alias("path"),
    )
    bad = active.select(
        "id", "parent", F.lit(-1).cast("long").alias("root_id"), F.lit(-1).cast("long").alias("depth"),
        F.lit(True).alias("in_cycle"), F.lit(None).cast("array<bigint>").alias("path"),
    )
    out = good.unionByName(bad)
    return out if paths else out.drop("path")


def _doubled(scratch: Scratch, state: DataFrame, step) -> DataFrame:
    """Rounds of pointer doubling over ``state`` (id, ptr: the ancestor at the round's exact distance or null, value).

    ``step(state, jumped)`` gives the new values (id, value) from the state and ``jumped`` (id, value, onto: the
    ancestor's value, next: the ancestor's pointer) of the nodes with a pointer. Ends when no pointer is left.
    """
    while True:
        left = state.filter("ptr IS NOT NULL").count()
        if not left:
            return state
        known = state.select(F.col("id").alias("_id"), F.col("value").alias("onto"), F.col("ptr").alias("next"))
        active = state.filter("ptr IS NOT NULL")
        met = lookup_join(active, known, "ptr", "_id") if left > HOT_FLOOR else active.join(known, F.col("ptr") == F.col("_id"))
        jumped = scratch.keep(met.select("id", "ptr", "value", "onto", "next"))
        state = scratch.keep(step(state, jumped))


def intervals(spark: SparkSession, resolved: DataFrame) -> DataFrame:
    """(id, root_id, depth, first, last, n_descendants): labels that tell all descendants without listing pairs.

    ``resolved`` is the result of ``resolve_hierarchy``. Within a root's tree a node's descendants are exactly those
    whose ``first`` lies above its own first and up to its last. Children are numbered in the order of their ids.
    Subtree sizes are summed by pointer doubling, each round adding what lies beyond the distance so far; the sizes
    before a node among its siblings, summed along its ancestors by doubling again, are its place. The work is the
    number of nodes times the logarithm of the depth. Nodes in or below a cycle have no rows.
    """
    scratch = Scratch(spark, "intervals")
    good = scratch.keep(resolved.filter("NOT in_cycle").select("id", "parent", "root_id", "depth"))

    def grown(state: DataFrame, jumped: DataFrame) -> DataFrame:
        more = jumped.groupBy("ptr").agg(F.sum("value").alias("_more")).select(F.col("ptr").alias("_p"), "_more")
        up = jumped.select(F.col("id").alias("_i"), "next")
        return state.select("id", "value").join(more, F.col("id") == F.col("_p"), "left").join(up, F.col("id") == F.col("_i"), "left").select(
            "id", F.col("next").alias("ptr"), (F.col("value") + F.coalesce("_more", F.lit(0))).alias("value"))

    def summed(state: DataFrame, jumped: DataFrame) -> DataFrame:
        done = state.filter("ptr IS NULL").select("id", "ptr", "value")
        return done.unionByName(jumped.select("id", F.col("next").alias("ptr"), (F.col("value") + F.col("onto")).alias("value")))

    start = good.select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("value"))
    sizes = _doubled(scratch, scratch.keep(start), grown).select("id", F.col("value").alias("size"))
    sized = scratch.keep(good.join(sizes, "id"))
    before, _ = ranked(spark, sized.filter("parent IS NOT NULL").select("parent", "id", "size"), "parent", [F.col("id")], ["id"], "siblings", "size")
    offset = before.select(F.col("id").alias("_i"), (F.col("before") + 1).alias("_off"))
    offsets = sized.select("id", "parent").join(offset, F.col("id") == F.col("_i"), "left")
    places = _doubled(scratch, scratch.keep(offsets.select("id", F.col("parent").alias("ptr"), F.coalesce("_off", F.lit(0)).cast("long").alias("value"))), summed)
    rows = sized.join(places.select("id", F.col("value").alias("first")), "id")
    return rows.select("id", "root_id", "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("n_descendants"))


#: Places of the ranges that descendants are looked up by.
RANGE = 4096


def descendants(labels: DataFrame, asked: Column | None = None) -> DataFrame:
    """(ancestor_id, descendant_id, hops) of the nodes of ``intervals`` that ``asked`` (a condition on it) is true of.

    Nodes meet by root and range of places, so neither a hot root nor a long chain is one key. Asked of all nodes, the
    pairs grow with the square of a chain's length; the labels themselves do not.
    """
    number = lambda c: F.floor(c / RANGE)
    up = labels.filter(F.lit(True) if asked is None else asked).filter("n_descendants > 0").select(
        F.col("id").alias("ancestor_id"), F.col("root_id").alias("_root"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("depth").alias("_depth"),
        F.explode(F.sequence(number(F.col("first") + 1), number(F.col("last")))).alias("_r"),
    )
    down = labels.select("id", "root_id", "first", "depth", number(F.col("first")).alias("_at"))
    within = (F.col("root_id") == F.col("_root")) & (F.col("_at") == F.col("_r")) & (F.col("first") > F.col("_first")) & (F.col("first") <= F.col("_last"))
    return up.join(down, within).select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("_depth")).alias("hops"))


def artifact_links(views: DataFrame) -> DataFrame:
    """(id, parent) of the newest export of each artifact (ties: the greater created_at, then links)."""
    nodes = latest(
        views, "id", ["exported_at", "created_at"], ["supersedes", "superseded_by"]
    )
    return parent_links(nodes)
