"""Cutting a source text into chunks of bounded size at statement boundaries."""

from __future__ import annotations

import re

#: Estimated tokens (bytes / 4) that chunks aim at and never exceed.
TARGET, MOST = 1200, 2000

_DECLARED = re.compile(
    r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|enum|type|namespace|const|let|var)\s+([A-Za-z_$][\w$]*)"
)
_IMPORT = re.compile(r"^(?:import\b|export\s+(?:\*|\{)[^=]*from\b)")


def units(source: str) -> list[tuple[int, int]]:
    """(start, end) line spans of top-level statements: a new one begins at a line without indentation that
    closes nothing. Comments directly above a statement belong to it."""
    lines = source.split("\n")
    starts: list[int] = []
    block = False
    for i, line in enumerate(lines):
        plain = line.strip()
        was = block
        if plain.startswith("/*") and "*/" not in plain:
            block = True
        elif block and "*/" in plain:
            block = False
        if was or not plain or line[:1] in " \t" or plain[0] in "})]":
            continue
        above = lines[i - 1].strip() if i else ""
        if starts and above and (above.startswith(("//", "*/", "*")) or above.endswith("*/")) and _comment_above(lines, starts[-1], i):
            continue
        starts.append(i)
    if not starts:
        return [(0, len(lines))] if source.strip() else []
    starts[0] = 0
    return list(zip(starts, [*starts[1:], len(lines)]))


def _comment_above(lines: list[str], start: int, at: int) -> bool:
    """Whether all lines from ``start`` up to ``at`` are comment lines."""
    return all(x.strip().startswith(("//", "/*", "*")) for x in lines[start:at])


def tokens(text: str) -> int:
    return (len(text.encode("utf-8", "surrogatepass")) + 3) // 4


def chunks(source: str) -> list[tuple[str, str | None, int, int, str]]:
    """(kind, name, first line, last line, text), lines from 1. Adjacent imports merge; anonymous statements merge
    up to the target; a named declaration stands alone; what is larger than the most is cut at line ends, its
    parts named name#part1, name#part2 ..."""
    lines = source.split("\n")
    out: list[tuple[str, str | None, int, int]] = []
    for start, end in units(source):
        text = "\n".join(lines[start:end])
        code = next((x for x in lines[start:end] if x.strip() and not x.strip().startswith(("//", "/*", "*"))), "")
        m = _DECLARED.match(code)
        if _IMPORT.match(code):
            kind, name = "imports", None
        elif m:
            kind, name = ("class" if m[1] == "class" else "function" if m[1].startswith("function") else "module"), m[2]
        else:
            kind, name = "module", None
        last = out[-1] if out else None
        joined = "\n".join(lines[last[2] : end]) if last else ""
        if last and name is None and last[1] is None and last[0] == kind and (kind == "imports" or tokens(joined) <= TARGET):
            out[-1] = (kind, None, last[2], end)
        elif text.strip():
            out.append((kind, name, start, end))
    return [c for kind, name, a, b in out for c in _parts(kind, name, a, b, lines)]


def _parts(kind: str, name: str | None, start: int, end: int, lines: list[str]) -> list[tuple[str, str | None, int, int, str]]:
    while end > start + 1 and not lines[end - 1].strip():
        end -= 1
    if tokens("\n".join(lines[start:end])) <= MOST:
        return [(kind, name, start + 1, end, "\n".join(lines[start:end]))]
    out, at = [], start
    while at < end:
        size, stop = tokens(lines[at]), at + 1
        if size > MOST:  # a line above the maximum is cut inside, at whole characters
            for part in _within(lines[at]):
                out.append((kind, f"{name or kind}#part{len(out) + 1}", at + 1, at + 1, part))
            at += 1
            continue
        while stop < end and size + tokens(lines[stop]) + 1 <= TARGET:
            size += tokens(lines[stop]) + 1
            stop += 1
        out.append((kind, f"{name or kind}#part{len(out) + 1}", at + 1, stop, "\n".join(lines[at:stop])))
        at = stop
    return out


def _within(line: str) -> list[str]:
    """Parts of a long line of at most TARGET tokens each."""
    out, at = [], 0
    while at < len(line):
        stop = min(len(line), at + TARGET)
        while stop < len(line) and tokens(line[at : stop + 64]) <= TARGET:
            stop += 64
        while stop > at + 1 and tokens(line[at:stop]) > TARGET:
            stop = at + max(1, (stop - at) * TARGET // tokens(line[at:stop]))
        out.append(line[at : min(stop, len(line))])
        at = stop
    return out
