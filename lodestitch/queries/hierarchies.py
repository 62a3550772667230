"""Queries of the hierarchy operator over artifact_views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import artifact_links, descendants, intervals, resolve_hierarchy
from ..session import table
from .registry import Registry

REG = Registry()

_SQL = """
WITH RECURSIVE newest AS (
  SELECT id, supersedes, superseded_by FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY exported_at DESC NULLS LAST, created_at DESC NULLS LAST,
      supersedes DESC NULLS LAST, superseded_by DESC NULLS LAST) AS rn
    FROM artifact_views WHERE id IS NOT NULL) WHERE rn = 1),
par AS (
  SELECT a.id, coalesce(p.id, s.pid) AS parent FROM newest a
  LEFT JOIN newest p ON a.supersedes = p.id
  LEFT JOIN (SELECT superseded_by AS cid, min(id) AS pid FROM newest WHERE superseded_by IS NOT NULL GROUP BY 1) s
    ON s.cid = a.id),
down AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(id AS VARCHAR) AS path FROM par WHERE parent IS NULL
  UNION ALL
  SELECT par.id, down.root_id, down.depth + 1, down.path || '/' || par.id FROM par JOIN down ON par.parent = down.id)
"""


@REG.add("p1_found", _SQL + """
SELECT par.id, coalesce(down.root_id, -1) AS root_id, coalesce(down.depth, -1) AS depth
FROM par LEFT JOIN down ON down.id = par.id WHERE par.parent IS NOT NULL""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = artifact_links(table(spark, sf_dir, "artifact_views"))
    return resolve_hierarchy(spark, links).filter(F.col("parent").isNotNull()).select("id", "root_id", "depth")


@REG.add("p1_paths", _SQL + """
SELECT par.id, coalesce(down.root_id, -1) AS root_id, coalesce(down.depth, -1) AS depth, down.path AS path,
  down.id IS NULL AS in_cycle FROM par LEFT JOIN down ON down.id = par.id""")
def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = artifact_links(table(spark, sf_dir, "artifact_views"))
    return resolve_hierarchy(spark, links, paths=True).select(
        "id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "in_cycle"
    )


_UP = """,
up AS (
  SELECT par.id AS descendant_id, par.parent AS ancestor_id, CAST(1 AS BIGINT) AS hops
  FROM par JOIN down ON down.id = par.id WHERE par.parent IS NOT NULL
  UNION ALL
  SELECT up.descendant_id, par.parent, up.hops + 1 FROM up JOIN par ON par.id = up.ancestor_id
  WHERE par.parent IS NOT NULL)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, resolve_hierarchy(spark, artifact_links(table(spark, sf_dir, "artifact_views"))))


@REG.add("p1_intervals", _SQL.replace("CAST(id AS VARCHAR) AS path", "[id] AS path").replace("down.path || '/' || par.id", "list_append(down.path, par.id)") + _UP + """,
n AS (SELECT ancestor_id AS id, count(*) AS n FROM up GROUP BY 1),
o AS (SELECT id, root_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS first FROM down)
SELECT o.id, root_id, depth, first, first + coalesce(n, 0) AS last, coalesce(n, 0) AS n_descendants FROM o LEFT JOIN n USING (id)""")
def p1_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@REG.add("p1_descendants", _SQL + _UP + " SELECT ancestor_id, descendant_id, hops FROM up WHERE ancestor_id % 50 = 0")
def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # its statement asks for every id divisible by 50 only; p1_all_descendants lists those of all ids
    return descendants(_labels(spark, sf_dir), F.col("id") % 50 == 0)


@REG.add("p1_all_descendants", _SQL + _UP + " SELECT ancestor_id, descendant_id, hops FROM up")
def p1_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_labels(spark, sf_dir))
