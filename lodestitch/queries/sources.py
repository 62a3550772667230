"""Sources, sinks and per-file extraction over the catalog tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunker
from ..operators import retrieval as R
from ..session import Scratch, table
from ..sources import files as S
from ..sources import tables as T
from .registry import Registry

REG = Registry()
c = F.col


def put(name, sql, f):
    REG.add(name, sql)(f)


def with_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "files").select("id", "path", "role", "origin", "repo").join(table(s, d, "source_files").select(c("file_id").alias("id"), "content"), "id")


def chunked(s: SparkSession, d: str) -> DataFrame:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, n, *x[:4], len(x[4])) for i, text in zip(pdf["file_id"], pdf["content"]) for n, x in enumerate(chunker.chunks(text or ""))]
            yield pd.DataFrame(rows, columns=["file_id", "position", "kind", "name", "first_line", "last_line", "n_chars"])

    return table(s, d, "source_files").select("file_id", "content").mapInPandas(
        cut, "file_id long, position long, kind string, name string, first_line long, last_line long, n_chars long"
    )


put("s1_source_walk", r"""SELECT id, path FROM files WHERE regexp_matches(path, '\.(?:js|jsx|ts|tsx|mjs|cjs|mts|cts)$') AND NOT regexp_matches(path, '(^|/)(?:\.[^/]*|node_modules|dist|coverage|out)/')""",
    lambda s, d: table(s, d, "files").filter(S.is_source(c("path"))).select("id", "path"))
put("s2_walk_rejections", "SELECT DISTINCT repo, regexp_replace(replace(trim(path), '\\', '/'), '^\\./', '') AS path, lower(trim(stage)) AS stage, error FROM walk_rejections",
    lambda s, d: table(s, d, "walk_rejections").select("repo", F.regexp_replace(F.translate(F.trim("path"), "\\", "/"), r"^\./", "").alias("path"), F.lower(F.trim("stage")).alias("stage"), "error").distinct())
put("s4_chunker", None, chunked)
put("s12_minified_filter", """SELECT id FROM (SELECT f.id, path, list_transform(string_split(content, chr(10))[1:5], lambda x: length(x)) AS n FROM files f JOIN source_files s ON s.file_id = f.id)
WHERE contains(path, '.min.') OR (n[1] > 4000 AND len(n) = 5 AND list_min(n[2:5]) > 1000)""",
    lambda s, d: with_text(s, d).filter(S.is_minified(c("path"), c("content"))).select("id"))


def republished(s: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(s, "published")
    T.publish(s, {"files": table(s, d, "files")}, scratch.root)
    Scratch._live.add(scratch.root)
    return s.read.schema(T.SCHEMAS["files"]).parquet(f"{T.published(s, scratch.root)}/files.parquet").select("id", "hash")


put("s14_g13_published_version", "SELECT id, hash FROM files", republished)
put("s17_upsert", "SELECT id, exported_at FROM (SELECT id, exported_at, row_number() OVER (PARTITION BY id ORDER BY is_current DESC, exported_at DESC) AS n FROM artifact_views WHERE is_current IS NOT NULL) WHERE n = 1",
    lambda s, d: (lambda v: T.upserted(v.filter("NOT is_current"), v.filter("is_current"), ["id"], "exported_at").select("id", "exported_at"))(
        table(s, d, "artifact_views").select("id", "exported_at", "is_current")))
put("s18_cascading_delete", "SELECT c.id FROM chunks c WHERE c.file_id NOT IN (SELECT id FROM files WHERE role = 'generated')",
    lambda s, d: T.without_files({"chunks": table(s, d, "chunks")}, table(s, d, "files").filter("role = 'generated'").select(c("id").alias("file_id")))["chunks"].select("id"))


def exported_lines(s: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(s, "lines")
    T.export_lines(table(s, d, "chunks").select("id", "kind", "name"), scratch.root)
    Scratch._live.add(scratch.root)
    return s.read.schema("id long, kind string, name string").json(scratch.root)


put("s20_s21_json_lines", "SELECT id, kind, name FROM chunks", exported_lines)
put("s22_v3_embedding_population", None, lambda s, d: T.embedded(
    table(s, d, "chunks").select("hash", "content").dropDuplicates(["hash"]).join(table(s, d, "semantic_embeddings").select(c("document_hash").alias("hash")), "hash", "left_anti"),
    "hash", "content", T.hashed_vectors, 16).select("hash", F.size("vec").cast("long").alias("dimensions")))
put("s23_request_batches", "SELECT repo, batch, count(*) AS n FROM (SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY id) - 1) // 128 AS batch FROM files) GROUP BY ALL",
    lambda s, d: table(s, d, "files").select("repo", F.floor((F.row_number().over(Window.partitionBy("repo").orderBy("id")) - 1) / 128).alias("batch")).groupBy("repo", "batch").agg(F.count(F.lit(1)).alias("n")))

# --- lookups and inventories ------------------------------------------------------------------------------------

put("q17_overview_totals", "SELECT lower(trim(origin)) AS origin, coalesce(lower(role), 'none') AS role, count(*) AS n_files, count(DISTINCT repo) AS n_repos FROM files GROUP BY ALL",
    lambda s, d: table(s, d, "files").groupBy(F.lower(F.trim("origin")).alias("origin"), F.coalesce(F.lower("role"), F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("repo").alias("n_repos")))
put("q19_semantic_overlay", "SELECT artifact_type, id, rank FROM (SELECT artifact_type, id, row_number() OVER (PARTITION BY artifact_type ORDER BY id DESC) AS rank FROM (SELECT DISTINCT artifact_type, id FROM artifact_views WHERE is_current AND freshness = 'fresh')) WHERE rank <= 10",
    lambda s, d: R.top_per_group(table(s, d, "artifact_views").filter("is_current AND freshness = 'fresh'").select("artifact_type", "id").distinct(), ["artifact_type"], [c("id").desc()], 10))
put("z19_evidence_packs", "SELECT repo, id, rank FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY length(path), path, id) AS rank FROM files) WHERE rank <= 6",
    lambda s, d: R.top_per_group(table(s, d, "files").select("repo", "id", "path"), ["repo"], [F.length("path"), c("path"), c("id")], 6).select("repo", "id", "rank"))
put("z30_physical_path", "SELECT f.id, CASE WHEN lower(trim(f.origin)) = 'dependency' THEN p.canonical_root || '/' || f.package_path ELSE f.path END AS physical FROM files f LEFT JOIN package_instances p ON p.id = f.package_instance_id",
    lambda s, d: table(s, d, "files").join(table(s, d, "package_instances").select(c("id").alias("pid"), "canonical_root"), c("package_instance_id") == c("pid"), "left").select(
        "id", F.when(F.lower(F.trim("origin")) == "dependency", F.concat("canonical_root", F.lit("/"), "package_path")).otherwise(c("path")).alias("physical")))
put("z5_z20_latest_for_inputs", "SELECT source_snapshot, max(id) AS id FROM artifact_views WHERE is_current GROUP BY 1",
    lambda s, d: table(s, d, "artifact_views").filter("is_current").groupBy("source_snapshot").agg(F.max("id").alias("id")))
put("z32_watch_targets", "SELECT DISTINCT canonical_root AS target FROM package_instances WHERE canonical_root IS NOT NULL UNION SELECT DISTINCT regexp_replace(path, '/[^/]+$', '') FROM files",
    lambda s, d: table(s, d, "package_instances").filter("canonical_root IS NOT NULL").select(c("canonical_root").alias("target")).union(table(s, d, "files").select(F.regexp_replace("path", "/[^/]+$", ""))).distinct())
