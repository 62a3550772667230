"""Projection of evidence into a property graph: nodes, and edges with explicit confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def nodes(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(node_key, node_kind, display_name, file_id) of files, symbols and imported packages."""
    of_files = files.select(F.concat(F.lit("file:"), "path").alias("node_key"), F.lit("file").alias("node_kind"), F.col("path").alias("display_name"), F.col("id").alias("file_id"))
    of_symbols = symbols.select("node_key", F.lit("symbol").alias("node_kind"), F.col("name").alias("display_name"), "file_id")
    of_packages = imports.filter("package IS NOT NULL").select(
        F.concat(F.lit("pkg:"), "package").alias("node_key"), F.lit("package").alias("node_kind"), F.col("package").alias("display_name"), F.lit(None).cast("long").alias("file_id")
    ).distinct()
    return of_files.unionByName(of_symbols).unionByName(of_packages)


def _edge(src, dst, kind: str, confidence) -> list:
    conf = F.lit(confidence) if isinstance(confidence, str) else confidence
    return [src.alias("src_key"), dst.alias("dst_key"), F.lit(kind).alias("kind"), conf.alias("confidence")]


def contains_edges(symbols: DataFrame) -> DataFrame:
    return symbols.select(*_edge(F.concat(F.lit("file:"), "path"), F.col("node_key"), "contains", "certain"))


def import_edges(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges of resolved requests (``modules.module_edges``): file to file, or file to package.

    Requests for types only have kinds of their own; a file reached by a workspace name is likely, others certain;
    unresolved requests have no edge.
    """
    at = files.select(F.col("id").alias("_f"), F.concat(F.lit("file:"), "path").alias("_key"))
    rows = resolved.join(at.select(F.col("_f").alias("from_file"), F.col("_key").alias("src")), "from_file").join(
        at.select(F.col("_f").alias("to_file"), F.col("_key").alias("dst")), "to_file", "left")
    to_file = rows.filter("dst IS NOT NULL").select(
        F.col("src").alias("src_key"), F.col("dst").alias("dst_key"), F.when(F.col("type_only"), "imports_types").otherwise("import").alias("kind"),
        F.when(F.col("resolution") == "workspace", "likely").otherwise("certain").alias("confidence"))
    to_package = rows.filter("package IS NOT NULL").select(
        F.col("src").alias("src_key"), F.concat(F.lit("pkg:"), "package").alias("dst_key"),
        F.when(F.col("type_only"), "imports_package_types").otherwise("import").alias("kind"), F.lit("certain").alias("confidence"))
    return to_file.unionByName(to_package).distinct()


#: A name that more symbols bear than this is reached through a hub node, so that callers and symbols do not multiply.
DIRECT = 3


def reference_edges(symbols: DataFrame, refs: DataFrame, imports: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Calls, renderings and extensions from symbols to what they name.

    In this order: a symbol of that name in the same file (certain); the symbol that an import's export chain lands on
    (certain, likely through a workspace name), ``chains`` being file_id, local_name, def_file, def_name, confidence; the
    package an import names (likely); else every symbol of that name (possible), however many bear it: up to DIRECT
    of them by an edge each, more through one hub node of the name with edges of kind ``name_candidate``.
    A name imported from a file in which nothing is found has no edge.
    """
    caller = symbols.select(F.col("symbol_id").alias("chunk_id"), F.col("node_key").alias("src"))
    scratch = Scratch(symbols.sparkSession, "calls")  # read by every branch below
    calls = scratch.keep(refs.join(caller, "chunk_id").select("src", "file_id", "kind", "target_name").distinct())
    target = symbols.select(F.col("file_id").alias("_f"), F.col("name").alias("_n"), F.col("node_key").alias("dst"))
    on_name = (F.col("file_id") == F.col("_f")) & (F.col("target_name") == F.col("_n"))
    local = calls.join(target, on_name).filter("src <> dst").select("src", "dst", "kind", F.lit("certain").alias("confidence"))
    rest = scratch.keep(calls.join(target.select("_f", "_n").distinct(), on_name, "left_anti"))
    named = imports.filter("local_name IS NOT NULL").select(F.col("file_id").alias("_if"), F.col("local_name").alias("_in"), "package")
    on_import = (F.col("file_id") == F.col("_if")) & (F.col("target_name") == F.col("_in"))
    parts = [local, rest.join(named.filter("package IS NOT NULL"), on_import).select("src", F.concat(F.lit("pkg:"), "package").alias("dst"), "kind", F.lit("likely").alias("confidence"))]
    if chains is not None:
        ends = chains.select(F.col("file_id").alias("_if"), F.col("local_name").alias("_in"), F.col("def_file").alias("_f"), F.col("def_name").alias("_n"), "confidence")
        parts.append(rest.join(ends, on_import).join(target, ["_f", "_n"]).select("src", "dst", "kind", "confidence"))
    free = scratch.keep(rest.join(named.select("_if", "_in").distinct(), on_import, "left_anti"))
    per_name = target.groupBy("_n").agg(F.count(F.lit(1)).alias("_bear"))
    few, many = per_name.filter(F.col("_bear") <= DIRECT).select("_n"), per_name.filter(F.col("_bear") > DIRECT).select("_n")
    possible = F.lit("possible").alias("confidence")
    parts.append(free.join(target.join(few, "_n", "left_semi").select("_n", "dst"), F.col("target_name") == F.col("_n")).select("src", "dst", "kind", possible))
    hub = lambda name: F.concat(F.lit("name:unknown:"), name).alias("dst")
    wide = free.join(many, F.col("target_name") == F.col("_n"), "left_semi")
    parts.append(wide.select("src", hub(F.col("target_name")), "kind", possible))
    used = wide.select(F.col("target_name").alias("_n")).distinct()
    parts.append(target.join(used, "_n", "left_semi").select(hub(F.col("_n")).alias("src"), "dst", F.lit("name_candidate").alias("kind"), possible))
    return reduce(DataFrame.unionByName, parts).select(F.col("src").alias("src_key"), F.col("dst").alias("dst_key"), "kind", "confidence").distinct()


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_key, dst_key, confidence) of the call edges to ``targets`` (node_key), those through name hubs included."""
    to = targets.select(F.col("node_key").alias("dst_key")).distinct()
    direct = edges.filter("kind = 'call'").join(to, "dst_key", "left_semi").select("src_key", "dst_key", "confidence")
    hubs = edges.filter("kind = 'name_candidate'").join(to, "dst_key", "left_semi").select(F.col("src_key").alias("_hub"), "dst_key")
    wide = edges.filter("kind = 'call'").select("src_key", F.col("dst_key").alias("_hub"), "confidence").join(hubs, "_hub")
    return direct.unionByName(wide.filter("src_key <> dst_key").select("src_key", "dst_key", "confidence")).distinct()


def member_edges(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """Member calls go to one hub node per property that some symbol is named like, and the hub to each such
    symbol, so that n callers and m symbols make n + m edges instead of n times m."""
    caller = symbols.select(F.col("symbol_id").alias("chunk_id"), F.col("node_key").alias("src"))
    hubs = members.select("prop").distinct().join(symbols.select(F.col("name").alias("prop")).distinct(), "prop", "left_semi")
    hub = F.concat(F.lit("member:unknown:"), "prop")
    into = members.join(hubs, "prop", "left_semi").join(caller, "chunk_id").select(*_edge(F.col("src"), hub, "member_call", "possible")).distinct()
    out = symbols.select(F.col("name").alias("prop"), "node_key").join(hubs, "prop", "left_semi").select(*_edge(hub, F.col("node_key"), "member_candidate", "possible"))
    return into.unionByName(out)


def event_edges(files: DataFrame, sites: DataFrame) -> DataFrame:
    """A file contains its event sites (certain); a site that emits points to the hub of the event's name, the hub to
    the sites that listen (possible). Sites are numbered in the order of (name, method, chunk)."""
    at = files.select(F.col("id").alias("file_id"), "path")
    order = Window.partitionBy("file_id").orderBy("name", "role", "method", "chunk_id")
    rows = sites.join(at, "file_id").withColumn("_no", F.row_number().over(order))
    site = F.concat(F.lit("event-site:"), "path", F.lit(":"), F.col("_no").cast("string"))
    hub = F.concat(F.lit("event:unknown:"), "name")
    holds = rows.select(*_edge(F.concat(F.lit("file:"), "path"), site, "contains_event", "certain"))
    emits = rows.filter("role = 'emit'").select(*_edge(site, hub, "emits", "possible"))
    listens = rows.filter("role = 'listen'").select(*_edge(hub, site, "listens", "possible"))
    return holds.unionByName(emits).unionByName(listens)


def deduplicated(edges: DataFrame, rank) -> DataFrame:
    """One edge per (source, target, kind): the most confident."""
    w = Window.partitionBy("src_key", "dst_key", "kind").orderBy(rank.desc())
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
