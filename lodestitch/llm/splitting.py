"""Splitting oversized items at natural boundaries with a sparse-table range-maximum index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A piece is cut no earlier than at this share of the limit, if a boundary exists beyond it.
LEAST_FILL = 0.5

_LINES = re.compile(r"[^\n]*\n|[^\n]+")
#: Strength of a cut after a mark within a line, above that of none (1) and of a blank (2) and below any line end.
INNER = {";": 9, "}": 8, ">": 5, ",": 6, ")": 5, "]": 4, "{": 3, "(": 2, "[": 2}
_ATOMS = re.compile(r"[^;,{}()\[\]>\s]*(?:\r\n|[;,{}()\[\]>\s])|[^;,{}()\[\]>\s]+")


class RangeMax:
    """Sparse table over integers: the rightmost position of the maximum of a range in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # ties break rightward: the position is the low part of the key
        self.levels = [values.astype(np.int64) * (n + 1) + np.arange(n)]
        self.mod, width = n + 1, 1
        while 2 * width <= n:
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def rightmost(self, lo: int, hi: int) -> int:
        """Position of the maximum of values[lo..hi], both inclusive."""
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]) % self.mod)


def _fragments(line: str, limit: int) -> list[tuple[str, int]]:
    """(atom, strength of a cut after it) of a line longer than the limit: cut after each punctuation mark or blank,
    and what is still longer than the limit at a character boundary."""
    out: list[tuple[str, int]] = []
    for atom in _ATOMS.findall(line):
        strength = INNER.get(atom[-1], 1 if not atom[-1].isspace() else 2)
        while len(atom.encode()) > limit:
            take = max(1, len(atom.encode()[:limit].decode(errors="ignore")))  # one character may exceed the limit
            out.append((atom[:take], 1))
            atom = atom[take:]
        if atom:
            out.append((atom, strength))
    return out


def boundary_strengths(atoms: list[str], whole: list[bool], inner: list[int] | None = None) -> np.ndarray:
    """Strength of a cut after each atom: outer indentation, closed blocks and blank lines make it stronger.

    A cut inside a line is the weakest (``inner`` tells its strength after an atom), then one between two lines of code deep in a block; the strongest is a
    blank line between two top-level statements.
    """
    n = len(atoms)
    depth = np.zeros(n + 1, dtype=np.int64)
    blank = np.zeros(n + 1, dtype=bool)
    ahead = 0
    for i in range(n - 1, -1, -1):
        text = atoms[i].strip()
        blank[i] = not text
        if text:
            body = atoms[i].expandtabs(4)
            ahead = len(body) - len(body.lstrip())
            closer = text[0] in "})]" or text.startswith(("</", "*/"))
            depth[i] = min(ahead, 60) + (2 if closer or text.startswith("*") else 0)
        else:
            depth[i] = min(ahead, 60)
    out = np.zeros(n, dtype=np.int64)
    for i in range(n):
        if not whole[i]:
            out[i] = inner[i] if inner else 1
            continue
        end = atoms[i].rstrip()
        after = 240 - 3 * int(depth[i + 1])
        if blank[i]:
            after += 30
        elif end.endswith(("}", "};", ");", "*/", ">")):
            after += 15
        elif end.endswith((";", ",")):
            after += 5
        elif end.endswith(("{", "(", "[", "=>")):
            after -= 20
        if i + 1 < n and blank[i + 1]:
            after -= 10  # the blank line stays with what it ends
        out[i] = max(after, 2) + 10
    return out


def split_text(text: str, limit: int, overlap_lines: int) -> list[tuple[int, int, str]]:
    """Pieces (first line, last line, text) of ``text``, lines counted from 0, each at most ``limit`` bytes.

    The strongest cut in the permissible window (LEAST_FILL of the limit up to the limit) is taken, the
    rightmost of equals; the next piece steps back by the last ``overlap_lines`` whole lines as far as these
    leave room for at least one more. Without the repeated lines the pieces join to ``text``. An empty text
    has no pieces. Only a single character larger than the limit exceeds it.
    """
    atoms: list[str] = []
    whole: list[bool] = []
    line_of: list[int] = []
    starts: list[bool] = []
    inner: list[int] = []
    for no, line in enumerate(_LINES.findall(text)):
        parts = [(line, 0)] if len(line.encode()) <= limit else _fragments(line, limit)
        for k, (part, strength) in enumerate(parts):
            atoms.append(part)
            inner.append(strength)
            whole.append(k == len(parts) - 1)
            starts.append(k == 0)
            line_of.append(no)
    if not atoms:
        return []
    ends = np.array([0, *accumulate(len(a.encode()) for a in atoms)])
    index = RangeMax(boundary_strengths(atoms, whole, inner))
    out, at, fresh, n = [], 0, 0, len(atoms)
    while True:
        most = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 2
        most = max(most, fresh)
        if most >= n - 1:
            out.append((line_of[at], line_of[n - 1], "".join(atoms[at:n])))
            return out
        least = int(np.searchsorted(ends, ends[at] + int(limit * LEAST_FILL), side="left")) - 1
        cut = index.rightmost(min(max(least, fresh), most), most)
        out.append((line_of[at], line_of[cut], "".join(atoms[at : cut + 1])))
        fresh = cut + 1
        at = fresh
        need = ends[fresh + 1] - ends[fresh]
        for _ in range(overlap_lines):
            # only whole lines are repeated, and only if the next new atom still fits
            prev = at - 1
            if prev <= 0 or not whole[prev] or not starts[prev] or ends[fresh] - ends[prev] + need > limit:
                break
            at = prev


def kind_key(c: str) -> F.Column:
    """Letters of a kind in lower case, without a plural s."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), "[^a-z]", ""), "s$", "")


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the ``items`` (id, kind, content, start_line, end_line) above the byte limit of their kind.

    ``limits`` (kind, max_bytes, overlap_lines) is one row per kind, a fixed small table; kinds are matched
    without case, separators and plural. Items with a null content or an unknown kind have no limit and, like
    those within it, no rows. A piece's line span counts from start_line; if that is missing or cannot be right
    (below 1, or behind end_line), back from end_line; if neither can be right, the span is null.

    Result: chunk_id, kind (as in limits), piece (from 0), pieces, start_line, end_line, n_bytes, content.
    """
    few = limits.select(
        kind_key("kind").alias("_key"), F.col("kind").alias("_kind"), F.col("max_bytes").cast("long").alias("_max"),
        F.coalesce(F.col("overlap_lines"), F.lit(0)).cast("long").alias("_overlap"),
    ).filter(F.col("_max") > 0).dropDuplicates(["_key"])
    large = (
        items.select("id", kind_key("kind").alias("_k"), "content", "start_line", "end_line")
        .join(F.broadcast(few), F.col("_k") == F.col("_key"), "inner")
        .filter(F.octet_length("content") > F.col("_max"))
        .select("id", "_kind", "_max", "_overlap", "content", "start_line", "end_line")
    )
    schema = (
        "chunk_id long, kind string, piece long, pieces long, start_line long, end_line long, n_bytes long, content string"
    )
    return large.mapInPandas(_split_batches, schema)


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False, name=None):
            id_, kind, limit, overlap, content, start, end = row
            pieces = split_text(content, int(limit), int(overlap))
            first = _first_line(start, end, content)
            for k, (lo, hi, text) in enumerate(pieces):
                span = (None, None) if first is None else (first + lo, first + hi)
                out.append((id_, kind, k, len(pieces), *span, len(text.encode()), text))
        frame = pd.DataFrame(
            out, columns=["chunk_id", "kind", "piece", "pieces", "start_line", "end_line", "n_bytes", "content"]
        )
        yield frame.astype({"start_line": "Int64", "end_line": "Int64"})


def _first_line(start: float, end: float, content: str) -> int | None:
    """The line the content begins at. Where start and end line contradict the number of lines, the one that can be
    right counts: the start if it is a line number and leaves the end behind it, else the end."""
    lines = content.count("\n") + (not content.endswith("\n"))
    has_start, has_end = (x is not None and x == x for x in (start, end))
    by_end = int(end) - lines + 1 if has_end else 0
    if has_start and int(start) >= 1 and (not has_end or int(end) >= int(start) or by_end < 1):
        return int(start)
    if by_end >= 1:
        return by_end
    return int(start) if has_start and int(start) >= 1 else None
