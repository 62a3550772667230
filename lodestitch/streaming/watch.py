"""Change signals: classification, debounced generations, and incremental refresh, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Distinct paths of one generation beyond which a full refresh is cheaper.
MANY_PATHS = 256
#: Scope of a signal by its class, and the greatest wins when signals merge (fixed values).
SCOPE = {"ignore": 0, "source": 1, "external": 2, "boundary": 3}


def scope_rank(name: Column) -> Column:
    return F.when(name == "boundary", 3).when(name == "external", 2).when(name == "source", 1).otherwise(0)


def classified(path: Column) -> Column:
    """ignore, source, external or boundary for a changed path."""
    return (
        F.when(path.rlike(r"(^|/)(\.git|node_modules|dist|\.next|coverage|out)(/|$)") & ~path.rlike(r"(^|/)\.git/HEAD$"), "ignore")
        .when(path.rlike(r"(^|/)(package\.json|pnpm-workspace\.yaml|tsconfig[^/]*\.json|\.gitignore|HEAD)$"), "boundary")
        .when(path.rlike(r"\.(js|jsx|ts|tsx|mjs|cjs|mts|cts)$"), "source")
        .otherwise("external")
    )


def generations(signals: DataFrame, root: str, ts: str, quiet_seconds: float) -> DataFrame:
    """``signals`` with ``generation``: a new one begins after ``quiet_seconds`` without a signal of the root.

    Trailing debounce over a log: gaps and islands by one window per root.
    """
    w = Window.partitionBy(root).orderBy(ts)
    seconds = F.col(ts).cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(w)
    starts = F.when(gap.isNull() | (gap >= quiet_seconds), 1).otherwise(0)
    return signals.withColumn("_starts", starts).withColumn(
        "generation", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_starts")


def merged(generation_rows: DataFrame, root: str, ts: str, path: str, scope: Column) -> DataFrame:
    """One row per generation: its span, signals, greatest scope and whether many paths make it a full refresh."""
    per = generation_rows.groupBy(root, "generation").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_signals"),
        F.count_distinct(path).alias("n_paths"), F.max(scope).cast("long").alias("scope"),
    )
    return per.withColumn("full_refresh", (F.col("n_paths") > MANY_PATHS) | (F.col("scope") >= 3))


def stream_sessions(spark: SparkSession, source: DataFrame, root: str, ts: str, quiet: str, late: str) -> DataFrame:
    """The same generations from a stream: session windows per root, written to the shared folder when they close.

    Runs what is available and returns the written table. A session closes when the watermark passes its end, so
    those still open at the end of the stream are not in the result.
    """
    scratch = Scratch(spark, "sessions")
    out, state = f"{scratch.root}/out", f"{scratch.root}/state"
    source = source.withColumn(ts, F.col(ts).cast("timestamp"))
    sessions = source.withWatermark(ts, late).groupBy(root, F.session_window(ts, quiet)).agg(F.count(F.lit(1)).alias("n_signals"))
    flat = sessions.select(root, F.col("session_window.start").alias("first_ts"), "n_signals")
    query = flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    Scratch._live.add(scratch.root)
    return spark.read.schema(flat.schema).parquet(out)


def refresh_plan(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action) from a full outer compare of two versions: added, changed, removed or kept."""
    o = old.select(F.col(key).alias("_ok"), F.col(digest).alias("_od"))
    n = new.select(F.col(key).alias("_nk"), F.col(digest).alias("_nd"))
    action = (
        F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed")
        .when(F.col("_od").eqNullSafe(F.col("_nd")), "kept").otherwise("changed")
    )
    return o.join(n, F.col("_ok") == F.col("_nk"), "full").select(F.coalesce("_nk", "_ok").alias(key), action.alias("action"))


def refreshed(derived: DataFrame, plan: DataFrame, key: str, rebuilt: DataFrame) -> DataFrame:
    """Derived rows after a refresh: those of kept keys, and ``rebuilt`` rows of added and changed ones.

    Equals a full rebuild, as derived rows depend on their own key alone.
    """
    kept = derived.join(plan.filter("action = 'kept'").select(key), key, "left_semi")
    new = rebuilt.join(plan.filter(F.col("action").isin("added", "changed")).select(key), key, "left_semi")
    return kept.unionByName(new)
