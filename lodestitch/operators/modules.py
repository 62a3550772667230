"""Module resolution: from a file's request to a file of the repository or a package, and export chains over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import package_name
from ..session import Scratch

#: Extensions tried in order, and what a written extension may stand for (fixed values).
EXTENSIONS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
STANDS_FOR = {"js": ["ts", "tsx", "js", "jsx"], "mjs": ["mts", "mjs"], "cjs": ["cts", "cjs"]}


def joined_path(path: Column, request: Column) -> Column:
    """The path of a relative ``request`` seen from the file ``path``: ``.`` and ``..`` are taken away."""
    folder = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    step = lambda at, part: (
        F.when(part.isin(".", ""), at).when(part == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, part))
    )
    return F.array_join(F.aggregate(F.split(request, "/"), folder, step), "/")


def candidates(base: Column) -> Column:
    """Paths that a request for ``base`` may mean, the first that exists wins."""
    ext = F.regexp_extract(base, r"\.([a-z]+)$", 1)
    stem = F.regexp_replace(base, r"\.[a-z]+$", "")
    written = F.array(base)
    for e, others in STANDS_FOR.items():
        written = F.when(ext == e, F.array(*[F.concat(stem, F.lit(f".{o}")) for o in others])).otherwise(written)
    added = F.array(*[F.concat(base, F.lit(f".{e}")) for e in EXTENSIONS])
    index = F.array(*[F.concat(base, F.lit(f"/index.{e}")) for e in EXTENSIONS])
    return F.concat(written, added, index)


def module_edges(files: DataFrame, requests: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(from_file, request, to_file, package, resolution, type_only): where each request of a file leads.

    ``files``: id, path, repo; ``requests``: file_id, request, type_only (any number of rows); ``packages``: name and
    root of workspace packages, whose entry file stands for the bare name. A relative request leads to the first of
    its ``candidates`` in the same repository (resolution ``resolver``); a workspace package's to its entry or the
    file below its root (``workspace``); another bare one to its package, without resolution; the rest is
    ``unresolved``. An edge is type_only if no request of it is for run time. Null requests are left out; requests of
    files without a row too. Distinct (folder, request) pairs meet the path map, not every import.
    """
    asked = requests.filter(F.col("request").isNotNull()).groupBy("file_id", "request").agg(F.bool_and("type_only").alias("type_only"))
    at = files.select(F.col("id").alias("from_file"), "path", F.coalesce("repo", F.lit("")).alias("repo"))
    rows = asked.join(at, F.col("file_id") == F.col("from_file"))
    relative = F.col("request").rlike(r"^\.{1,2}(?:/|$)")
    base = F.when(relative, joined_path(F.col("path"), F.col("request")))
    if packages is not None:
        known = packages.select(F.col("name").alias("package"), F.col("root").alias("_root")).dropDuplicates(["package"])
        rows = rows.withColumn("package", package_name(F.col("request"))).join(known, "package", "left")
        below = F.expr("substring(request, length(package) + 1)")
        base = F.coalesce(base, F.when(F.col("_root").isNotNull() & (below == ""), F.concat("_root", F.lit("/src"))), F.concat("_root", below))
    else:
        rows = rows.withColumn("_root", F.lit(None).cast("string"))
    rows = rows.withColumn("base", base).drop("package")
    wanted = rows.filter("base IS NOT NULL").select("repo", "base").distinct().select("repo", "base", F.posexplode(candidates(F.col("base"))).alias("_at", "_path"))
    paths = files.select(F.coalesce("repo", F.lit("")).alias("repo"), F.col("path").alias("_path"), F.col("id").alias("to_file"))
    hit = wanted.join(paths, ["repo", "_path"]).groupBy("repo", "base").agg(F.min(F.struct("_at", "to_file")).alias("_b")).select("repo", "base", "_b.to_file")
    found = rows.join(hit, ["repo", "base"], "left")
    package = F.when(F.col("to_file").isNull() & ~relative, package_name(F.col("request")))
    resolution = (
        F.when(F.col("to_file").isNotNull() & F.col("_root").isNotNull() & ~relative, "workspace").when(F.col("to_file").isNotNull(), "resolver")
        .when(package.isNull(), "unresolved")
    )
    return found.select("from_file", "request", "to_file", package.alias("package"), resolution.alias("resolution"), "type_only")


def linked_exports(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """``exports`` with from_file, the file that from_request leads to (null if to none)."""
    to = edges.filter("to_file IS NOT NULL").select(F.col("from_file").alias("_f"), F.col("request").alias("_r"), F.col("to_file").alias("from_file"))
    return exports.join(to, (F.col("file_id") == F.col("_f")) & (F.col("from_request") == F.col("_r")), "left").drop("_f", "_r")


def export_chains(spark: SparkSession, exports: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Where an exported name is defined, through re-exports.

    ``exports``: file_id, export_name ('*' for all), local_name (null for a re-export), from_file, from_name
    ('*' for a namespace). ``wanted`` (file_id, export_name) are the names to look up, by default all that are listed
    under a name. At each file an exact entry wins over stars; among stars the one whose chain is least by the order
    of from_file. A star passes on every name but ``default``. A namespace ends at its file with the name ``*``. Rounds
    join the frontier with the next file until it is empty; a (file, name) already visited on the chain ends it, so
    cycles give no definition and every chain ends. Result: file_id, export_name, def_file, def_name, hops.
    """
    scratch = Scratch(spark, "chains")
    e = scratch.keep(exports.select("file_id", "export_name", "local_name", "from_file", "from_name"))
    x = e.select(*[F.col(n).alias(f"_{n}") for n in e.columns])
    names = e.filter("export_name <> '*'").select("file_id", "export_name") if wanted is None else wanted.select("file_id", "export_name")
    mark = F.concat_ws("\0", F.col("at_file").cast("string"), "at_name")
    frontier = scratch.keep(names.distinct().select(
        "file_id", "export_name", F.col("file_id").alias("at_file"), F.col("export_name").alias("at_name"), F.array().cast("array<string>").alias("order"),
    ).withColumn("seen", F.array(mark)))
    done, hop = None, 0
    while True:
        exact = frontier.join(x, (F.col("at_file") == F.col("_file_id")) & (F.col("at_name") == F.col("_export_name")))
        ends = exact.filter("_local_name IS NOT NULL").select(
            "file_id", "export_name", F.col("at_file").alias("def_file"), F.col("_local_name").alias("def_name"), F.lit(hop).cast("long").alias("hops"), "order")
        spaces = exact.filter("_local_name IS NULL AND _from_name = '*' AND _from_file IS NOT NULL").select(
            "file_id", "export_name", F.col("_from_file").alias("def_file"), F.lit("*").alias("def_name"), F.lit(hop + 1).cast("long").alias("hops"), "order")
        found = scratch.keep(ends.unionByName(spaces))
        done = found if done is None else done.unionByName(found)
        star = frontier.filter("at_name <> 'default'").join(
            exact.select("file_id", "export_name", "order").distinct(), ["file_id", "export_name", "order"], "left_anti"
        ).join(x.filter("_export_name = '*'"), F.col("at_file") == F.col("_file_id"))
        step = lambda df, name: df.select(
            "file_id", "export_name", F.col("_from_file").alias("at_file"), name.alias("at_name"), "seen",
            F.array_append("order", F.lpad(F.col("_from_file").cast("string"), 20, "0")).alias("order"))
        onward = step(exact.filter("_local_name IS NULL AND _from_name <> '*'"), F.col("_from_name")).unionByName(step(star, F.col("at_name")))
        # of the chains of one length that reach a place, the least decides
        fresh = onward.filter(F.col("at_file").isNotNull() & ~F.array_contains("seen", mark)).withColumn("seen", F.array_append("seen", mark))
        least = fresh.groupBy("file_id", "export_name", "at_file", "at_name").agg(F.min(F.struct("order", "seen")).alias("_b"))
        frontier = scratch.keep(least.select("file_id", "export_name", "at_file", "at_name", "_b.order", "_b.seen"))
        hop += 1
        if frontier.isEmpty():
            break
    best = done.groupBy("file_id", "export_name").agg(F.min(F.struct("order", "def_file", "def_name", "hops")).alias("_b"))
    return best.select("file_id", "export_name", "_b.def_file", "_b.def_name", "_b.hops")
