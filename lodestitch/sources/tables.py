"""Versioned tables: schemas, publication, upserts, cascading deletes and exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

#: Columns of the catalog's tables.
SCHEMAS = {
    "files": "id long, path string, hash string, role string, origin string, package_instance_id long, package_path string, repo string",
    "chunks": "id long, file_id long, kind string, name string, scope_chain string, symbols string, start_byte long, end_byte long,"
    " start_line long, end_line long, hash string, content string",
    "artifact_views": "id long, supersedes long, superseded_by long, artifact_type string, name string, is_current boolean, trust string,"
    " body string, model string, prompt_version string, confidence string, source_snapshot string, freshness string, support_count long,"
    " created_at timestamp, exported_at timestamp",
}


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables into a new version folder, then point to it; readers see all of them or none.

    The pointer is a small table of its own, written last; its newest row names the version.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}.parquet")
    pointer = spark.createDataFrame([(version, SCHEMA_VERSION)], "version string, schema_version int").withColumn("published_at", F.current_timestamp())
    pointer.write.mode("append").parquet(f"{root}/_published")
    return version


def published(spark: SparkSession, root: str) -> str:
    """Folder of the version published last; refuses another schema version."""
    row = spark.read.parquet(f"{root}/_published").orderBy(F.col("published_at").desc(), "version").first()
    if row.schema_version != SCHEMA_VERSION:
        raise ValueError(f"schema version {row.schema_version} is not {SCHEMA_VERSION}")
    return f"{root}/{row.version}"


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old and new rows with one row per key: the new one, and among new ones the last by ``order``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def without_files(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """The tables without rows of removed files (file_id); files by their id."""
    gone = removed.select(F.col("file_id").alias("_gone")).distinct()
    return {n: t.join(gone, F.col("id" if n == "files" else "file_id") == F.col("_gone"), "left_anti") for n, t in tables.items()}


def must_rewrite(n_changed: int, n_all: int) -> bool:
    """Whether so much changed that writing anew beats deleting by file: half or more."""
    return n_all > 0 and 2 * n_changed >= n_all


def export_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def batched(items: list, most: int, most_bytes: int) -> list[list]:
    """Batches of at most ``most`` items and ``most_bytes`` bytes of JSON; too large ones are halved."""
    out, todo = [], [items[i : i + most] for i in range(0, len(items), most)]
    while todo:
        batch = todo.pop(0)
        if len(batch) > 1 and len(json.dumps(batch).encode()) > most_bytes:
            half = len(batch) // 2
            todo[:0] = [batch[:half], batch[half:]]
        else:
            out.append(batch)
    return out


def embedded(texts: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 64) -> DataFrame:
    """(key, vec) of each text from an embedding provider, called in batches inside the partitions.

    The provider's answer must have a vector of the right length for each text; anything else fails the batch.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                vectors = provider(part[text].fillna("").tolist())
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError("the provider's answer does not fit the request")
                yield pd.DataFrame({key: part[key].to_numpy(), "vec": vectors})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vec array<float>")


def hashed_vectors(texts: list[str]) -> list[list[float]]:
    """A deterministic local provider for tests: signed counts of hashed words in 16 dimensions, unit length."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * 16
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % 16] += 1.0 if h & 16 else -1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


#: Bounds of a dependency scan: bytes and files of a package, and bytes of one file (fixed values).
SCAN_BYTES, SCAN_FILES, SCAN_EACH = 100 << 20, 10_000, 2 << 20


def greedy_budget(
    files: DataFrame, group: str, order: list, size: str, budget: int, forced: str, most: int | None = None, each: int | None = None
) -> DataFrame:
    """``files`` with ``taken``: in order, forced rows first, each file that still fits its group's byte budget, as long
    as fewer than ``most`` are taken and the file has at most ``each`` bytes. A null size counts as 0.

    A file that does not fit is skipped and later ones may still fit, which no running sum says; each group is
    folded in a task, with only keys and sizes in it.
    """
    kind = {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([forced, *order], ascending=[False] + [True] * len(order))
        used, n_taken, taken = 0, 0, []
        for n, must in zip(pdf[size].fillna(0), pdf[forced]):
            room = used + n <= budget and (each is None or n <= each) and (most is None or n_taken < most)
            ok = bool(must) or bool(room)
            used += int(n) if ok else 0
            n_taken += ok
            taken.append(ok)
        return pdf.assign(taken=taken)

    schema = ", ".join(f"{n} {k}" for n, k in kind.items()) + ", taken boolean"
    return files.groupBy(group).applyInPandas(fold, schema)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
