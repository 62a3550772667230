"""Versioned artifacts: current view, freshness from evidence and children, related artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..session import Scratch

#: Freshness from best to worst (fixed values); an unknown one counts as fresh.
FRESHNESS = {"fresh": 0, "degraded": 1, "stale": 2}
#: Levels of children that count for an artifact's freshness.
RELATION_DEPTH = 8


def freshness_rank(c: Column) -> Column:
    return lookup(c, FRESHNESS, 0)


def freshness_name(rank: Column) -> Column:
    return F.when(rank >= 2, "stale").when(rank == 1, "degraded").otherwise("fresh")


def current(artifacts: DataFrame) -> DataFrame:
    """Artifacts (unique id) that no other one supersedes."""
    named = artifacts.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"))
    return artifacts.join(named, "id", "left_anti")


def support_freshness(supports: DataFrame, evidence: DataFrame) -> DataFrame:
    """(artifact_id, evidence_id, state): source-stale if the evidence is gone, context-stale if it is no longer
    current, else fresh."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.col("is_current").alias("_current"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "source-stale").when(~F.coalesce("_current", F.lit(False)), "context-stale").otherwise("fresh")
    return supports.join(e, "evidence_id", "left").select("artifact_id", "evidence_id", state.alias("state"))


def stored_freshness(supports: DataFrame) -> DataFrame:
    """(artifact_id, chunk_id, state) of supports with what was stored of source and context and what they are now:
    source-stale if the source differs, context-stale if only the context does. Nulls equal each other."""
    state = (
        F.when(~F.col("stored_hash").eqNullSafe(F.col("now_hash")), "source-stale")
        .when(~F.col("stored_context").eqNullSafe(F.col("now_context")), "context-stale").otherwise("fresh")
    )
    return supports.select("artifact_id", "chunk_id", state.alias("state"))


def claims(runs: DataFrame, key: list[str], now: DataFrame, days: int) -> DataFrame:
    """``runs`` (key, id, exported_at) with claim: of the runs of a key the newest is live, or an orphan if it is older
    than ``days`` before ``now`` (one row); older ones are superseded. One live claim a key, so a late one replaces it."""
    newest = runs.groupBy(*key).agg(F.max(F.struct("exported_at", "id")).alias("_newest"))
    rows = runs.join(newest, key).crossJoin(F.broadcast(now))
    first = F.struct("exported_at", "id") == F.col("_newest")
    old = F.col("exported_at") < F.col("now") - F.make_interval(days=F.lit(days))
    return rows.withColumn("claim", F.when(~first, "superseded").when(old, "orphan").otherwise("live")).drop("_newest", "now")


def artifact_freshness(states: DataFrame) -> DataFrame:
    """(artifact_id, n, n_fresh, freshness): all supports fresh, some, or none."""
    per = states.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "fresh").alias("n_fresh"))
    return per.withColumn("freshness", F.when(F.col("n") == F.col("n_fresh"), "fresh").when(F.col("n_fresh") > 0, "degraded").otherwise("stale"))


def hierarchical_freshness(spark: SparkSession, own: DataFrame, links: DataFrame, depth: int = RELATION_DEPTH) -> DataFrame:
    """(id, freshness): an artifact's own freshness, degraded if a child's is not fresh, over ``depth`` levels.

    ``own``: id unique, freshness; ``links``: parent, child. A round takes the worst of the children; rounds are
    written to the shared folder, so the plan stays short.
    """
    scratch = Scratch(spark, "freshness")
    e = scratch.keep(links.select("parent", "child").distinct())
    state = scratch.keep(own.select("id", freshness_rank(F.col("freshness")).alias("rank")))
    for _ in range(depth):
        bad = state.filter("rank > 0").select(F.col("id").alias("child"))
        touched = e.join(bad, "child", "left_semi").select(F.col("parent").alias("id")).distinct().withColumn("_bad", F.lit(1))
        new = scratch.keep(state.join(touched, "id", "left").select("id", F.greatest("rank", F.coalesce("_bad", F.lit(0))).alias("rank")))
        changed = new.agg(F.sum("rank")).first()[0] != state.agg(F.sum("rank")).first()[0]
        state = new
        if not changed:
            break
    return state.select("id", freshness_name(F.col("rank")).alias("freshness"))


def related(links: DataFrame) -> DataFrame:
    """(id, other, side) of each relation from both ends."""
    return links.select(F.col("parent").alias("id"), F.col("child").alias("other"), F.lit("child").alias("side")).unionByName(
        links.select(F.col("child").alias("id"), F.col("parent").alias("other"), F.lit("parent").alias("side"))
    )


def evidence_paths(spark: SparkSession, links: DataFrame, roots: DataFrame, depth: int = RELATION_DEPTH) -> DataFrame:
    """(root, path, hops) of all simple paths down from the roots, by a recursive query; cycles are skipped."""
    links.select("parent", "child").distinct().createOrReplaceTempView("_evidence_links")
    roots.select("id").distinct().createOrReplaceTempView("_evidence_roots")
    return spark.sql(f"""
        WITH RECURSIVE down(root, node, path, hops) MAX RECURSION LEVEL {depth + 1} AS (
          SELECT id, id, array(id), 0 FROM _evidence_roots
          UNION ALL
          SELECT down.root, l.child, array_append(down.path, l.child), down.hops + 1
          FROM down JOIN _evidence_links l ON l.parent = down.node
          WHERE down.hops < {depth} AND NOT array_contains(down.path, l.child))
        SELECT root, array_join(CAST(path AS ARRAY<STRING>), '>') AS path, CAST(hops AS BIGINT) AS hops FROM down WHERE hops > 0""")


def validated_append(existing: DataFrame, new: DataFrame, known_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of new artifacts (id, hash, path): the path must be indexed with that
    hash, and neither the id nor an equal new row may be there already."""
    f = known_files.select(F.col("path").alias("_p"), F.col("hash").alias("_h"))
    checked = new.join(f, F.col("path") == F.col("_p"), "left").join(
        existing.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left"
    )
    reason = F.when(F.col("_p").isNull(), "unknown path").when(~F.col("hash").eqNullSafe(F.col("_h")), "changed source").when(F.col("_id").isNotNull(), "duplicate")
    judged = checked.select(*new.columns, reason.alias("reason")).distinct()
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
