"""Scopes of a repository, their evidence and the policy that follows from classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import repository_area, set_digest
from .skew import ranked


def scopes(files: DataFrame) -> DataFrame:
    """(scope, n_files, n_roles, priority): areas, packages before others, larger first."""
    area = files.select(repository_area(F.col("path")).alias("scope"), "role")
    per = area.groupBy("scope").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("role").alias("n_roles"))
    return per.withColumn("priority", F.when(F.col("scope").startswith("packages/"), 0).otherwise(1).cast("long"))


def subdivided(files: DataFrame, scope: str) -> DataFrame:
    """(child, n_files) of a scope: its immediate folders, and its direct files as "."."""
    inside = files.filter(F.col("path").startswith(scope + "/"))
    rest = F.split(F.expr(f"substring(path, {len(scope) + 2})"), "/")
    child = F.when(F.size(rest) > 1, F.element_at(rest, 1)).otherwise(".")
    return inside.groupBy(child.alias("child")).agg(F.count(F.lit(1)).alias("n_files"))


def evidence_fingerprint(spark: SparkSession, files: DataFrame, members: int = 8) -> DataFrame:
    """(repo, fingerprint): digest of all paths and of the hashes of members evenly spread over them.

    Places come from a distributed rank and only the few members of a repository are gathered.
    """
    at, _ = ranked(spark, files.select("repo", "path", "hash"), "repo", [F.col("path"), F.col("hash")], ["path", "hash"])
    picks = F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda i: F.floor(i * (F.col("total") - 1) / (members - 1)))
    chosen = at.filter(F.exists(picks, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n"))))
    few = chosen.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", "hash"))), lambda x: x["hash"]), ",").alias("_few"))
    every = files.groupBy("repo").agg(set_digest(F.col("path")).alias("_all"))
    return every.join(few, "repo").select("repo", F.sha2(F.concat_ws(":", "_all", "_few"), 256).alias("fingerprint"))


def reconciled(classifications: DataFrame) -> DataFrame:
    """Newest valid classification of each subject whose ancestors have no definite one.

    ``classifications``: id, subject, role, confidence, valid. A subject's ancestors are the folders above it; a
    definite (certain) one decides for all below.
    """
    w = Window.partitionBy("subject").orderBy(F.col("id").desc())
    newest = classifications.filter("valid").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    parts = F.split("subject", "/")
    ups = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    definite = newest.filter("confidence = 'certain'").select(F.col("subject").alias("_up"))
    covered = newest.select("subject", F.explode(ups).alias("_up")).join(definite, "_up", "left_semi").select("subject").distinct()
    return newest.join(covered, "subject", "left_anti").select("subject", "id", "role", "confidence")
