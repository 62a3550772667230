"""Evidence relations read from chunks and source texts: symbols, references, imports, member calls, events.

Extraction is by patterns over each text, in JVM expressions. It sees what a line-level reader sees: names that
are declared, called or imported; it does not bind scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import package_name

#: Words that look like calls and are none (fixed values).
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "function", "super", "await", "typeof", "constructor"]
#: Method names that emit or listen when the first argument is a plain string (fixed values).
EMITTERS = ["emit", "publish", "dispatch", "dispatchEvent", "trigger", "send"]
LISTENERS = ["on", "once", "off", "addListener", "addEventListener", "subscribe", "handle"]

CALL = r"(?:^|[^.\w$])([A-Za-z_$][\w$]*)\s*\("
MEMBER = r"([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)\s*\("
EVENT = r"\.([A-Za-z_$]+)\(\s*['\"]([^'\"\n]+)['\"]"
NAMED = r"import\s+(?:[A-Za-z_$][\w$]*\s*,\s*)?\{([^}]*)\}\s+from\s+['\"]([^'\"]+)['\"]"
WHOLE = r"import\s+([A-Za-z_$][\w$]*)(?:\s*,\s*\{[^}]*\})?\s+from\s+['\"]([^'\"]+)['\"]"
STAR = r"import\s+\*\s+as\s+([A-Za-z_$][\w$]*)\s+from\s+['\"]([^'\"]+)['\"]"
REQUIRE = r"(?:const|let|var)\s+(\{[^}]*\}|[A-Za-z_$][\w$]*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
DYNAMIC = r"(?:^|[^.\w$])(import|require)\(\s*['\"]([^'\"\n]+)['\"]\s*\)"
TYPES = r"import\s+type\s+(\{[^}]*\}|[A-Za-z_$][\w$]*)\s+from\s+['\"]([^'\"]+)['\"]"
#: Exports: a declaration, a default, a list (perhaps from another file), a star (perhaps named).
EXPORT_DECLARED = r"(?:^|\n)\s*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(const|let|var|function\*?|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
EXPORT_DEFAULT = r"(?:^|\n)\s*export\s+(default)\s+(?:async\s+)?(?:function\*?\s*|class\s+)?([A-Za-z_$][\w$]*)?"
EXPORT_LIST = r"(?:^|\n)\s*export\s+(?:type\s+)?\{([^}]*)\}(?:\s*from\s*['\"]([^'\"]+)['\"])?"
EXPORT_STAR = r"(?:^|\n)\s*export\s+\*(?:\s+as\s+([A-Za-z_$][\w$]*))?\s+from\s+['\"]([^'\"]+)['\"]"
#: A class that extends a name, and an element of a component.
EXTEND = r"\bclass\s+[A-Za-z_$][\w$]*\s+extends\s+([A-Za-z_$][\w$]*)"
RENDER = r"<([A-Z][\w$]*)[\s/>]"


def kind_name(kind: Column) -> Column:
    """Canonical chunk kind regardless of case, blanks, hyphens and number."""
    letters = F.regexp_replace(F.lower(kind), "[^a-z]", "")
    return F.when(letters.isin("import", "imports"), "imports").when(letters.startswith("classheader"), "class_header").otherwise(letters)


def _eager(pattern: str) -> str:
    """The pattern with names read possessively, which finds the same and never reads a name twice."""
    return pattern.replace(r"[\w$]*)", r"[\w$]*+)")


def _pairs(text: Column, pattern: str, a: str, b: str) -> Column:
    pattern = _eager(pattern)
    one = F.regexp_extract_all(text, F.lit(pattern), 1)
    two = F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.explode(F.arrays_zip(one.alias(a), two.alias(b)))


def symbols(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Declared symbols with their node key; ordinals number equal names of a scope by position, then id."""
    at = files.select(F.col("id").alias("_f"), "path", "role")
    rows = chunks.filter(F.col("name").isNotNull() & kind_name(F.col("kind")).isin("function", "class", "method", "component")).join(
        at, F.col("file_id") == F.col("_f")
    )
    scope = F.coalesce("scope_chain", F.lit(""))
    order = Window.partitionBy("path", scope, "name").orderBy("start_byte", "id")
    numbered = rows.withColumn("ordinal", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.col("id").alias("symbol_id"), "file_id", "path", "role", "name", kind_name(F.col("kind")).alias("kind"), scope.alias("scope"),
        F.col("start_byte").alias("decl_start"), F.col("end_byte").alias("decl_end"), F.col("start_line").alias("line"),
        F.col("content").rlike(r"^\s*export\b").alias("exported"), "ordinal",
        F.concat(F.lit("sym:"), "path", F.lit("#"), scope, F.lit("::"), "name", F.lit("@"), F.col("ordinal").cast("string")).alias("node_key"),
    )


def references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, target_name, n): names called in each chunk."""
    return typed_references(chunks).filter("kind = 'call'").drop("kind")


def typed_references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, kind, target_name, n): names called, extended and rendered in each chunk, in one scan."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(_eager(pattern)), 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target_name")))

    every = F.concat(found("call", CALL), found("extend", EXTEND), found("render", RENDER))
    rows = chunks.select(F.col("id").alias("chunk_id"), "file_id", F.explode(every).alias("_r")).select("chunk_id", "file_id", "_r.*")
    kept = rows.filter((F.col("kind") != "call") | ~F.col("target_name").isin(NOT_CALLS))
    return kept.groupBy("chunk_id", "file_id", "kind", "target_name").agg(F.count(F.lit(1)).alias("n"))


def member_calls(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, object, prop, n)."""
    pairs = chunks.select(F.col("id").alias("chunk_id"), "file_id", _pairs(F.col("content"), MEMBER, "object", "prop").alias("_p"))
    return pairs.select("chunk_id", "file_id", "_p.object", "_p.prop").groupBy("chunk_id", "file_id", "object", "prop").agg(F.count(F.lit(1)).alias("n"))


def event_sites(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, role, name, method) of calls whose first argument is a plain string."""
    pairs = chunks.select(F.col("id").alias("chunk_id"), "file_id", _pairs(F.col("content"), EVENT, "method", "name").alias("_p"))
    role = F.when(F.col("method").isin(EMITTERS), "emit").when(F.col("method").isin(LISTENERS), "listen")
    return pairs.select("chunk_id", "file_id", "_p.name", "_p.method").withColumn("role", role).filter("role IS NOT NULL").distinct()


def _named(names: Column) -> Column:
    """(imported, local) of each entry of a list in braces, where ``as`` or a colon renames."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    entries = F.filter(F.transform(F.split(F.regexp_replace(names, r"[{}]", ""), ","), bare), lambda x: x != "")
    words = F.transform(entries, lambda x: F.split(F.regexp_replace(x, r"^type\s+", ""), r"\s+as\s+|\s*:\s*"))
    return F.transform(words, lambda w: F.struct(F.element_at(w, 1).alias("imported"), F.element_at(w, -1).alias("local")))


def imports(sources: DataFrame) -> DataFrame:
    """(file_id, local_name, imported_name, request, package, type_only) of each file's imports: import statements,
    CommonJS requires bound to names, and dynamic imports and bare requires (local_name null)."""

    def pairs(pattern: str) -> Column:
        return F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("names"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("request"))

    def bound(pattern: str, imported: str, type_only: bool = False) -> Column:
        one = lambda p, i, n: F.struct(n.alias("local_name"), i.alias("imported_name"), p["request"].alias("request"), F.lit(type_only).alias("type_only"))
        listed = lambda p: F.transform(_named(p["names"]), lambda e: one(p, e["imported"], e["local"]))
        if imported == "list":
            return F.flatten(F.transform(pairs(pattern), listed))
        single = lambda p: F.array(one(p, F.lit(imported), F.when(F.lit(imported != "?"), p["names"])))
        if imported == "?":
            return F.flatten(F.transform(pairs(pattern), lambda p: F.array(one(p, F.lit("*"), F.lit(None).cast("string")))))
        return F.flatten(F.transform(pairs(pattern), lambda p: F.when(p["names"].startswith("{"), listed(p)).otherwise(single(p))))

    every = F.concat(
        bound(NAMED, "list"), bound(WHOLE, "default"), bound(STAR, "*"), bound(REQUIRE, "*"), bound(DYNAMIC, "?"), bound(TYPES, "default", True)
    )
    rows = sources.select("file_id", F.explode(every).alias("_i")).select("file_id", "_i.*")
    # a request is a type import only if nothing else of the file asks for that name
    once = rows.groupBy("file_id", "local_name", "imported_name", "request").agg(F.bool_and("type_only").alias("type_only"))
    return once.withColumn("package", package_name(F.col("request")))


def exports(sources: DataFrame) -> DataFrame:
    """(file_id, export_name, local_name, from_request, from_name) of each file: ``*`` is everything of the request.

    A declaration or local list has local_name, a re-export from_request and from_name; a default without a name has
    the local name ``default``.
    """

    def of(pattern: str, make) -> Column:
        both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("a"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("b"))
        return F.flatten(F.transform(both, make))

    none = F.lit(None).cast("string")
    row = lambda e, n, r, f: F.struct(e.alias("export_name"), n.alias("local_name"), r.alias("from_request"), f.alias("from_name"))
    filled = lambda x: F.when(x != "", x)
    every = F.concat(
        of(EXPORT_DECLARED, lambda p: F.array(row(p["b"], p["b"], none, none))),
        of(EXPORT_DEFAULT, lambda p: F.array(row(F.lit("default"), F.coalesce(filled(p["b"]), F.lit("default")), none, none))),
        of(EXPORT_LIST, lambda p: F.transform(_named(p["a"]), lambda e: row(
            e["local"], F.when(p["b"] == "", e["imported"]), filled(p["b"]), F.when(p["b"] != "", e["imported"])))),
        of(EXPORT_STAR, lambda p: F.array(row(F.coalesce(filled(p["a"]), F.lit("*")), none, p["b"], F.lit("*")))),
    )
    return sources.select("file_id", F.explode(every).alias("_e")).select("file_id", "_e.*").distinct()
