"""Text functions that built-in expressions cannot say, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _per_value(f: Callable, kind: str) -> Callable[..., Column]:
    """A pandas function that applies ``f`` to every value but null. Made when used, as it needs a session."""

    def apply(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return F.pandas_udf(apply, kind)


def normalized(text: str) -> str:
    """Compatibility form in lower case with white space collapsed; punctuation stays."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def normalize(column: str) -> Column:
    return _per_value(normalized, "string")(column)


_CODE = re.compile(
    r"//[^\n]*|/\*(?s:.*?)(?:\*/|$)|'(?:[^'\\\n]|\\(?s:.))*(?:'|$|(?=\n))|\"(?:[^\"\\\n]|\\(?s:.))*(?:\"|$|(?=\n))"
    r"|`(?:[^`\\]|\\(?s:.))*(?:`|$)"
)


def code_only(source: str) -> str:
    """The source with comments, strings and templates blanked, offsets unchanged."""
    return _CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def mentions(source: str, identifier: str) -> bool:
    """Whether the identifier stands whole somewhere in the code, outside comments, strings and templates."""
    if identifier not in source:
        return False
    return re.search(rf"(?<![A-Za-z0-9_$]){re.escape(identifier)}(?![A-Za-z0-9_$])", code_only(source)) is not None


def contains_identifier(source: Column, identifier: Column) -> Column:
    def check(sources: pd.Series, identifiers: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or i is None else mentions(s, i) for s, i in zip(sources, identifiers)])

    return F.pandas_udf(check, "boolean")(source, identifier)


_CONTROL = re.compile(r"\b(?:if|else|for|while|do|switch|case|return|throw|try|catch|finally|await|yield|function|class|export|import)\b|=>|^\s*[})\]]")


def elided(source: str, marker: str = "  // ...") -> str:
    """Control-flow lines of a source; runs of other lines become one marker where that is shorter."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            out.extend(run if sum(map(len, run)) + len(run) <= len(marker) + 1 else [marker])
            run.clear()

    for line in source.split("\n"):
        if _CONTROL.search(line):
            flush()
            out.append(line)
        else:
            run.append(line)
    flush()
    return "\n".join(out)


def elide(column: str) -> Column:
    return _per_value(elided, "string")(column)
