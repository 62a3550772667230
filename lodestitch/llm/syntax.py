"""Source files that do not parse: all errors, the first cause, and acceptance rates."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ecma_parser import TOO_DEEP, syntax_errors

_SCHEMA = "file_id long, language string, valid boolean, n_errors long, first_line long, first_cause string, errors array<struct<line:long,message:string>>"


def extension(path: Column) -> Column:
    """Extension of a path in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\s*$", 1))


def check_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Parses the text of every file (``files``: id, path; ``sources``: file_id, content) as its extension says.

    Result per file with a row in both tables: file_id, language, valid, n_errors, first_line and first_cause
    (null if valid) and errors, all of them in order. A null or empty content is valid. A path with an extension
    that is no ECMAScript or TypeScript one is not judged: valid is null; so is a text without an error up to where
    it is nested deeper than RECURSION allows. Repeated rows of a file count once.
    """
    named = files.select(F.col("id").alias("file_id"), extension(F.col("path")).alias("language"))
    texts = sources.select("file_id", "content")
    return named.join(texts, "file_id", "inner").dropDuplicates(["file_id"]).mapInPandas(_check, _SCHEMA)


#: Calls of the interpreter in one another, about five for a level of nesting. Since Python 3.11 they take memory of
#: the heap and not of the stack.
RECURSION = 20_000_000
#: Verdicts a worker remembers, so that copies of a text among its files are parsed once.
REMEMBERED = 5_000


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION if sys.version_info >= (3, 11) else 20_000))
    known: dict[tuple[str, bytes], list[tuple[int, str]]] = {}
    for pdf in batches:
        out = []
        for file_id, language, content in zip(pdf["file_id"], pdf["language"], pdf["content"]):
            key = (language, hashlib.blake2b((content or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = syntax_errors(content, language) if content else []
            found = known[key]
            if found and found[0][1] in ("unknown language", TOO_DEEP):
                out.append((file_id, language, None, 0, None, None, []))
                continue
            lines = [{"line": content.count("\n", 0, at) + 1, "message": message} for at, message in found]
            first = lines[0] if lines else {"line": None, "message": None}
            out.append((file_id, language, not lines, len(lines), first["line"], first["message"], lines))
        frame = pd.DataFrame(out, columns=["file_id", "language", "valid", "n_errors", "first_line", "first_cause", "errors"])
        yield frame.astype({"valid": "boolean", "first_line": "Int64"})


def log_path(path: Column) -> Column:
    """A logged path with forward slashes and without a leading dot."""
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^\./", "")


def with_hints(checked: DataFrame, files: DataFrame, rejections: DataFrame) -> DataFrame:
    """``checked`` plus logged: whether the log has a parse rejection of the file.

    The log is unreliable, so this is a hint beside the verdict, not part of it. A logged path matches if it is
    the file's path or ends with it after the root of its repository's checkout.
    """
    at = files.select(F.col("id").alias("file_id"), "path", "repo")
    # the part of a logged path from a top folder of the repository on, for each depth
    parts = F.split(log_path(F.col("path")), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    log = rejections.filter(F.lower(F.trim("stage")) == "parse").select("repo", F.explode(tails).alias("path")).distinct()
    hit = at.join(log, ["repo", "path"], "left_semi").select("file_id", F.lit(True).alias("logged"))
    return checked.join(hit, "file_id", "left").withColumn("logged", F.coalesce("logged", F.lit(False)))


def rates(checked: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, invalid_rate, n_truncated, n_conflicts) of the judged files."""
    of = files.select(F.col("id").alias("file_id"), "repo").dropDuplicates(["file_id"])
    early = F.col("first_cause").contains("end of file")
    return (
        checked.filter(F.col("valid").isNotNull()).select("file_id", "language", "valid", "first_cause")
        .join(of, "file_id", "inner").groupBy("repo", "language").agg(
            F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"),
            F.round(F.count_if(~F.col("valid")) / F.count(F.lit(1)), 6).alias("invalid_rate"),
            F.count_if(early).alias("n_truncated"), F.count_if(F.col("first_cause") == "merge conflict marker").alias("n_conflicts"),
        )
    )
