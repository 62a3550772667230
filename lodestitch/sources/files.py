"""Reading source trees, and the predicates on paths and texts that select and classify files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of source files and folders that are never walked (fixed values).
EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"]
SKIPPED = ["node_modules", "dist", ".next", "coverage", "out"]
#: A first line longer than the first number, and the next four all longer than the second, mean minified.
LONG_LINE, LONG_LINES = 4000, 1000
#: Characters of a text that the role classifier looks at.
HEADER = 4096
#: Roles in the order they are tried: names of folders or files, and marks within a file's name (fixed values).
ROLES = {
    "generated": (["generated", "__generated__"], [".generated.", ".gen.", "_generated.", "-generated."]),
    "fixture": (["fixture", "fixtures", "__fixtures__", "mock", "mocks", "__mocks__", "stub", "stubs"], [".fixture.", ".fixtures.", ".mock.", ".stub."]),
    "test": (
        ["test", "tests", "__tests__", "testing", "spec", "specs", "e2e", "test-utils", "test_utils", "integration-tests"],
        [".test.", ".spec.", ".e2e.", ".e2e-spec.", ".integration-test."],
    ),
    "documentation": (["docs", "documentation", ".storybook", "stories"], [".stories.", ".story."]),
}
#: What the head of a generated file says (fixed values).
GENERATED_HEADS = [
    "@generated", "auto-generated", "autogenerated", "automatically generated", "this file was generated",
    "generated file - do not edit", "generated file. do not edit",
]


def is_source(path: Column) -> Column:
    """Whether a path has a source extension and lies in no hidden or skipped folder."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(SKIPPED))
    return path.rlike(r"\.(?:" + "|".join(EXTENSIONS) + ")$") & ~hidden


def walk(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, rejections) of a tree: path, content, hash of readable source files; path, stage, error of others.

    A text that is not valid UTF-8 is rejected. Paths are relative to the root.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^.*?" + root.rstrip("/").removeprefix("file:").replace(".", r"\.") + "/", "")
    seen = raw.select(path.alias("path"), "content").filter(is_source(F.col("path")))
    text = seen.withColumn("text", F.try_validate_utf8("content"))
    files = text.filter("text IS NOT NULL").select("path", F.col("text").alias("content"), F.sha2("content", 256).alias("hash"))
    rejected = text.filter("text IS NULL").select("path", F.lit("read").alias("stage"), F.lit("stream did not contain valid UTF-8").alias("error"))
    return files, rejected


def file_role(path: Column, text: Column) -> Column:
    """generated, fixture, test, documentation or production, the first that applies, from the path and the head."""
    lowered = F.lower(F.translate(path, "\\", "/"))
    parts = F.filter(F.split(lowered, "/"), lambda x: x != "")
    name = F.element_at(parts, -1)
    head = F.lower(F.substring(text, 1, HEADER))
    within = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    marked = lambda column, marks: reduce(lambda a, b: a | b, [column.contains(m) for m in marks])
    role = F.lit("production")
    for kind in reversed(ROLES):
        says = within(ROLES[kind][0]) | marked(name, ROLES[kind][1])
        if kind == "generated":
            says = says | marked(head, GENERATED_HEADS)
        role = F.when(F.coalesce(says, F.lit(False)), kind).otherwise(role)
    return role


def is_minified(path: Column, text: Column) -> Column:
    """Whether a name says .min. or the first five lines are very long."""
    lengths = F.transform(F.slice(F.split(text, "\n"), 1, 5), F.length)
    long = (F.element_at(lengths, 1) > LONG_LINE) & (F.size(lengths) == 5) & F.forall(F.slice(lengths, 2, 4), lambda n: n > LONG_LINES)
    return path.contains(".min.") | F.coalesce(long, F.lit(False))


def lines_of(spans: DataFrame, sources: DataFrame, key: str, file: str, offset: str) -> DataFrame:
    """(key, file, line): the line, from 1, of a byte offset of each span's file.

    The offsets of a file meet its text once; its line ends are found once and searched by all of them. Null offsets
    and files without a text have no rows; an offset beyond the end is in the last line.
    """
    kinds = dict(spans.dtypes)
    asked = spans.filter(F.col(offset).isNotNull()).groupBy(file).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(offset).cast("long").alias("at"))).alias("_asked"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, text, rows in zip(pdf[file], pdf["content"], pdf["_asked"]):
                ends = np.flatnonzero(np.frombuffer((text or "").encode(), dtype=np.uint8) == 10)
                at = np.array([r["at"] for r in rows])
                yield pd.DataFrame({key: [r["k"] for r in rows], file: f, "line": np.searchsorted(ends, at, side="left") + 1})

    texts = sources.select(file, "content").filter("content IS NOT NULL")
    return texts.join(asked, file).mapInPandas(find, f"{key} {kinds[key]}, {file} {kinds[file]}, line long")


def leading_comment_starts(spans: DataFrame, sources: DataFrame, key: str, file: str, offset: str) -> DataFrame:
    """(key, start): the byte offset of each span, moved back over a comment that only blanks with at most one line
    break part from it. Spans of a file meet its text once; null offsets and missing texts have no rows."""
    kinds = dict(spans.dtypes)
    asked = spans.filter(F.col(offset).isNotNull()).groupBy(file).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(offset).cast("long").alias("at"))).alias("_asked"))

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, rows in zip(pdf["content"], pdf["_asked"]):
                data = text.encode()
                yield pd.DataFrame({key: [r["k"] for r in rows], "start": [_before_comment(data, r["at"]) for r in rows]})

    texts = sources.select(file, "content").filter("content IS NOT NULL")
    return texts.join(asked, file).mapInPandas(back, f"{key} {kinds[key]}, start long")


def _before_comment(data: bytes, at: int) -> int:
    end = min(at, len(data))
    while end and data[end - 1] in b" \t\r\n":
        end -= 1
    if data.count(b"\n", end, at) > 1:
        return at
    if data[max(0, end - 2) : end] == b"*/":
        start = data.rfind(b"/*", 0, end)
        return start if start >= 0 else at
    line = data.rfind(b"\n", 0, end) + 1
    begin = line + len(data[line:end]) - len(data[line:end].lstrip())
    return begin if data[begin : begin + 2] == b"//" else at


def workspaces(manifests: DataFrame, globs: list[str]) -> DataFrame:
    """(root, name, entry) of workspace packages: ``manifests`` (path, text) whose folder a workspace glob matches.

    The text is JSON with name and main or module; entry defaults to src/index.ts. A manifest that does not parse, or
    has no name, is no package; of several with one name the least root counts.
    """
    pattern = reduce(lambda a, b: a | b, [F.regexp(F.col("root"), glob_pattern(F.lit(g))) for g in globs], F.lit(False))
    read = F.from_json("text", "name string, main string, module string")
    rows = manifests.select(F.regexp_replace("path", "/?[^/]*$", "").alias("root"), read.alias("m")).filter(pattern & F.col("m.name").isNotNull())
    entry = F.coalesce("m.module", "m.main", F.lit("src/index.ts"))
    return rows.groupBy(F.col("m.name").alias("name")).agg(F.min(F.struct("root", entry.alias("entry"))).alias("_b")).select("_b.root", "name", "_b.entry")


def glob_pattern(glob: Column) -> Column:
    """Regular expression of a workspace glob: ** for any depth, * within a folder."""
    plain = F.regexp_replace(glob, r"([.+^$(){}|\[\]])", r"\\$1")
    deep = F.regexp_replace(plain, r"\*\*/?", "\0")
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(deep, r"\*", "[^/]*"), F.lit("\0"), F.lit("(?:.*/)?")), F.lit("$"))
