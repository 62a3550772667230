"""Tokens of ECMAScript and TypeScript source, read on demand by the parser."""

from __future__ import annotations

import re

#: The kinds up to TEMPLATE are the groups of the token pattern.
EOF, NAME, NUMBER, STRING, PRIVATE, PUNCT, TEMPLATE, REGEX = range(8)


class SourceError(Exception):
    """A syntax error at an offset of the source."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at = at
        self.message = message


_SPACE = r"(?:[\s﻿]++|//[^\n\r  ]*+|/\*(?s:.*?)\*/)*+"
_NAME_START = r"(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})"
_NAME = _NAME_START + r"(?:[\w$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*+"
_NUMBER = (
    r"(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?"
    r"|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?n?)"
)
_STRING = r"""'(?:[^'\\\n\r]++|\\(?:\r\n|(?s:.)))*+'|"(?:[^"\\\n\r]++|\\(?:\r\n|(?s:.)))*+\""""
#: A closing angle is always one token, since it may end type arguments; the parser joins shifts itself.
_PUNCT = r"\.\.\.|=>|===?|!==?|\*\*=?|\+\+|--|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|<<=?|[-+*/%&|^]=|<=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]"

_TOKEN = re.compile(f"{_SPACE}(?:({_NAME})|({_NUMBER})|({_STRING})|(\\#{_NAME})|({_PUNCT})|(`))").match
_SKIP = re.compile(_SPACE).match
_ANGLE = re.compile(r">{1,3}=?").match
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)").match
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+(`|\$\{)").match
_WORDLIKE = re.compile(r"[\w$]").match


class Lexer:
    """The current token of a source: kind, text, start, end, and whether a line break precedes it."""

    __slots__ = ("src", "kind", "text", "start", "end", "newline", "last_end")

    def __init__(self, src: str):
        self.src = src
        self.kind, self.text, self.start, self.end, self.newline, self.last_end = EOF, "", 0, 0, True, 0

    def next(self) -> None:
        """Read the token after the current one."""
        pos = self.last_end = self.end
        m = _TOKEN(self.src, pos)
        if m is None:
            self._no_token(pos)
            return
        kind = m.lastindex
        self.text = text = m[kind]
        self.end = end = m.end()
        self.start = start = end - len(text)
        if start == pos:
            self.newline = False
        elif start == pos + 1:
            self.newline = self.src[pos] in "\n\r\u2028\u2029"
        else:
            gap = self.src[pos:start]
            self.newline = "\n" in gap or "\r" in gap or "\u2028" in gap or "\u2029" in gap
        if kind == NUMBER:
            if _WORDLIKE(self.src, end):
                raise SourceError(start, "malformed number")
        self.kind = kind

    def _no_token(self, pos: int) -> None:
        at = _SKIP(self.src, pos).end()
        self.newline = True
        self.start = at
        if at >= len(self.src):
            self.kind, self.text, self.end = EOF, "", at
            return
        char = self.src[at]
        self.kind, self.text, self.end = PUNCT, char, at + 1
        if char in "'\"":
            stop = re.compile(r"[\n\r]|$").search(self.src, at)
            self.end = max(stop.start(), at + 1)
            raise SourceError(at, "unterminated string")
        if self.src.startswith("/*", at):
            self.end = len(self.src)
            raise SourceError(at, "unterminated comment")
        raise SourceError(at, f"unexpected character {char!r}")

    def jump(self, pos: int) -> None:
        """Read the token at ``pos``."""
        self.end = pos
        self.next()

    def save(self) -> tuple:
        return (self.kind, self.text, self.start, self.end, self.newline, self.last_end)

    def load(self, state: tuple) -> None:
        self.kind, self.text, self.start, self.end, self.newline, self.last_end = state

    def angle(self) -> str:
        """The whole operator that begins with the current closing angle."""
        return _ANGLE(self.src, self.start)[0]

    def regex(self) -> None:
        """Read the current slash as a regular expression literal."""
        m = _REGEX(self.src, self.start)
        if m is None:
            raise SourceError(self.start, "unterminated regular expression")
        flags = m[1]
        if len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy"):
            raise SourceError(self.start, "invalid regular expression flags")
        self.kind, self.text, self.end = REGEX, "/", m.end()

    def template(self, pos: int) -> bool:
        """Read template characters from ``pos``; True if a substitution begins, False if the template ends."""
        m = _TEMPLATE(self.src, pos)
        if m is None:
            self.end = len(self.src)
            raise SourceError(self.start, "unterminated template")
        self.end = m.end()
        return m[1] == "${"
