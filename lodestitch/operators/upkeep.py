"""Upkeep of derived state: batches of checker work, carried answers, policies by path, guards, phases and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

#: Phases of a generation in order; only the first is run for one that a later signal supersedes (fixed values).
PHASES = ["refresh", "embed", "enrich", "semantic-embed"]
#: Seconds of the first retry, and the most (fixed values).
RETRY, RETRY_MOST = 0.5, 30.0
#: Pool of a late filter: at least so many, times so many, and once more if roles are filtered (fixed values).
POOL_LEAST, POOL_TIMES, POOL_FILTERED = 10, 5, 4


def owners(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, project): each occurrence with every project that owns its file, the repository's own and, for a
    file of a package instance, that one's. Files without either have no owner."""
    projects = F.array_compact(F.array(
        F.when(F.col("repo").isNotNull(), F.concat(F.lit("repo:"), "repo")),
        F.when(F.col("package_instance_id").isNotNull(), F.concat(F.lit("package:"), F.col("package_instance_id").cast("string"))),
    ))
    of = files.select(F.col("id").alias("file_id"), F.explode(projects).alias("project"))
    return occurrences.join(of, "file_id").select("chunk_id", "project")


def carried(owned: DataFrame, fresh: DataFrame) -> DataFrame:
    """(chunk_id, carried): an answer carries over only if every owning project is among the ``fresh`` (project)."""
    marks = fresh.select("project").distinct().withColumn("_fresh", F.lit(True))
    return owned.join(marks, "project", "left").groupBy("chunk_id").agg(F.bool_and(F.coalesce("_fresh", F.lit(False))).alias("carried"))


def batch_actions(projects: DataFrame, batch: str, status: str) -> DataFrame:
    """(batch, n, n_complete, action): activate a batch all of whose projects are complete, resume one with some,
    open one anew otherwise."""
    per = projects.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == "complete").alias("n_complete"))
    return per.withColumn("action", F.when(F.col("n") == F.col("n_complete"), "activate").when(F.col("n_complete") > 0, "resume").otherwise("open"))


def selected_owners(rows: DataFrame, group: str, purpose: Column) -> DataFrame:
    """``rows`` with selected and fallback: all but auxiliary ones of a group; all of them if that leaves none."""
    kept = rows.withColumn("_keep", F.coalesce(purpose != "auxiliary", F.lit(True)))
    some = kept.groupBy(group).agg(F.bool_or("_keep").alias("_some")).select(F.col(group).alias("_g"), "_some")
    joined = kept.join(some, F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, (F.col("_keep") | ~F.col("_some")).alias("selected"), (~F.col("_some")).alias("fallback"))


def checker_facts(facts: DataFrame, failed: DataFrame) -> DataFrame:
    """(occurrence, target, confidence, candidates) of facts (occurrence, target, project, possible).

    A target is certain only if no fact of it is merely possible and none comes from a failed project (``failed``:
    project); candidates counts the occurrence's distinct targets.
    """
    marks = failed.select("project").distinct().withColumn("_failed", F.lit(True))
    weak = F.col("possible") | F.coalesce("_failed", F.lit(False))
    per = facts.join(marks, "project", "left").groupBy("occurrence", "target").agg(F.bool_or(weak).alias("_weak"))
    n = per.groupBy("occurrence").agg(F.count(F.lit(1)).alias("candidates"))
    return per.join(n, "occurrence").select("occurrence", "target", F.when(F.col("_weak"), "possible").otherwise("certain").alias("confidence"), "candidates")


def overfetched(ranked: DataFrame, group: str, keep: Column, limit: int, by_role: bool = True) -> DataFrame:
    """The first ``limit`` rows of each group that pass ``keep``, looked for only in a pool of the first rows (column
    rank), as a search does that filters late; ``exhausted`` says that the pool had too few."""
    pool = max(limit, POOL_LEAST) * POOL_TIMES * (POOL_FILTERED if by_role else 1)
    w = Window.partitionBy(group).orderBy("rank")
    passed = ranked.filter((F.col("rank") <= pool) & keep).withColumn("place", F.row_number().over(w).cast("long"))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return passed.withColumn("exhausted", n < limit).filter(F.col("place") <= limit)


def reranked(ranked: DataFrame, scores: DataFrame, group: str, key: str, pool: int) -> DataFrame:
    """``ranked`` (group, key, rank) with the first ``pool`` of each group in the order of new ``scores`` (group, key,
    score) and the tail as it was; a group whose scores are not exactly one for each of the pool keeps its order and
    is ``degraded``. Result: group, key, rank, degraded."""
    s = scores.groupBy(group, key).agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("_score"))
    joined = ranked.join(s, [group, key], "left")
    inside = F.col("rank") <= pool
    bad = joined.filter(inside).groupBy(group).agg(F.bool_or((F.coalesce("_n", F.lit(0)) != 1) | F.col("_score").isNull()).alias("degraded"))
    rows = joined.join(bad, group)
    order = [(~inside).cast("int"), F.when(inside & ~F.col("degraded"), F.col("_score")).desc_nulls_last(), F.col("rank")]
    return rows.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long").alias("new_rank"), "degraded").withColumnRenamed("new_rank", "rank")


def shed(sections: DataFrame, group: str, tier: str, size: str, budget: int) -> DataFrame:
    """(group, tier, bytes, kept): sections are kept from the first tier on while all kept fit the budget; the first
    tier that does not fit and all after it are shed whole."""
    per = sections.groupBy(group, tier).agg(F.sum(size).alias("bytes"))
    upto = F.sum("bytes").over(Window.partitionBy(group).orderBy(tier).rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("kept", upto <= budget)


def superseded(generations: DataFrame, root: str, work_seconds: float) -> DataFrame:
    """``generations`` (root, generation, first_ts, last_ts) with superseded: a later one begins before the work on it,
    which starts at its last signal, has ended."""
    after = F.lead("first_ts").over(Window.partitionBy(root).orderBy("generation"))
    ends = F.col("last_ts").cast("timestamp").cast("double") + work_seconds
    return generations.withColumn("superseded", F.coalesce(after.cast("timestamp").cast("double") < ends, F.lit(False)))


def phases(generations: DataFrame) -> DataFrame:
    """A row for each phase a generation runs: all in order, or the first alone if it is superseded."""
    names = F.array(*[F.lit(p) for p in PHASES])
    run = F.when(F.col("superseded"), F.slice(names, 1, 1)).otherwise(names)
    return generations.select("*", F.posexplode(run).alias("step", "phase"))


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next try after ``attempt`` failures, doubled each time up to the most."""
    return F.least(F.lit(RETRY_MOST), F.lit(RETRY) * F.pow(F.lit(2.0), attempt.cast("double")))


def first_answers(attempts: DataFrame, request: str, order: list, ok: Column, most: int = 3) -> DataFrame:
    """(request, answered, tries): the first good attempt of each request among its first ``most``, in order."""
    n = F.row_number().over(Window.partitionBy(request).orderBy(*order))
    tried = attempts.withColumn("_n", n).filter(F.col("_n") <= most).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    per = tried.groupBy(request).agg(F.min(F.when(F.col("_ok"), F.col("_n"))).alias("_first"), F.max("_n").alias("_tried"))
    return per.select(request, F.col("_first").isNotNull().alias("answered"), F.coalesce("_first", "_tried").cast("long").alias("tries"))


def set_digest(value: Column) -> Column:
    """Order-free digest of a group's values, as an aggregate that combines on the map side."""
    return F.sum(F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def parsed_key(key: Column) -> Column:
    """Struct kind, path, scope, name, ordinal of a node key; path is the rest for keys other than a symbol's."""
    kind = F.substring_index(key, ":", 1)
    rest = F.regexp_replace(key, "^[a-z-]+:", "")
    is_symbol = kind == "sym"
    part = lambda n: F.when(is_symbol, F.regexp_extract(rest, r"^(.*?)#(.*)::(.*)@([0-9]+)$", n))
    return F.struct(kind.alias("kind"), F.when(is_symbol, part(1)).otherwise(rest).alias("path"), part(2).alias("scope"), part(3).alias("name"), part(4).try_cast("long").alias("ordinal"))


#: Verbs that a router's methods are named by, and what a holder of routes is called (fixed values).
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "all"]
ROUTER_HOLDERS = ["app", "router", "server", "fastify", "api", "routes"]


def http_method(prop: Column) -> Column:
    """The verb in capitals of a method name that is one, else null."""
    return F.when(F.lower(prop).isin(HTTP_METHODS), F.upper(prop))


def is_router_holder(name: Column) -> Column:
    """Whether an object's name says that it holds routes: one of the known names, or one that ends in Router."""
    return F.lower(name).isin(ROUTER_HOLDERS) | F.lower(name).endswith("router")


def static_string(literal: Column) -> Column:
    """The value of a quoted string, or of a template without or with constant substitutions (``${'x'}``); else null."""
    quoted = F.regexp_extract(literal, r"^'([^'\\]*)'$|^\"([^\"\\]*)\"$", 1)
    double = F.regexp_extract(literal, r"^\"([^\"\\]*)\"$", 1)
    folded = F.regexp_replace(literal, r"\$\{\s*['\"]([^'\"]*)['\"]\s*\}", "$1")
    template = F.regexp_extract(folded, r"^`([^`\\$]*)`$", 1)
    return (
        F.when(literal.rlike(r"^'[^'\\]*'$"), quoted).when(literal.rlike(r"^\"[^\"\\]*\"$"), double).when(folded.rlike(r"^`[^`\\$]*`$"), template)
    )


def contract_violations(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(parent, child) relations that break their contract: the child is missing, or less sure than its parent."""
    a = artifacts.select("id", X.confidence_rank(F.col("confidence")).alias("rank"))
    p = a.select(F.col("id").alias("parent"), F.col("rank").alias("_pr"))
    q = a.select(F.col("id").alias("child"), F.col("rank").alias("_cr"))
    rows = links.select("parent", "child").distinct().join(p, "parent", "left").join(q, "child", "left")
    missing = F.col("_cr").isNull() | F.col("_pr").isNull()
    return rows.filter(missing | (F.col("_cr") < F.col("_pr"))).select("parent", "child", F.when(missing, "missing").otherwise("less sure").alias("reason"))


def compact_graph(edges: DataFrame, usual: str = "certain") -> DataFrame:
    """(text, bytes): one JSON line an edge, nodes by their index in key order, the usual confidence left out."""
    nodes = edges.select(F.col("src_key").alias("key")).union(edges.select("dst_key")).distinct()
    index = nodes.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("at"))
    a, b = index.select(F.col("key").alias("src_key"), F.col("at").alias("a")), index.select(F.col("key").alias("dst_key"), F.col("at").alias("b"))
    text = F.to_json(F.struct("a", "b", "kind", F.when(F.col("confidence") != usual, F.col("confidence")).alias("confidence")))
    return edges.join(a, "src_key").join(b, "dst_key").select(text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))
