"""Queries over a property graph of nodes and edges."""

from __future__ import annotations

import heapq
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import Scratch
from .skew import lookup_join


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, other, kind, confidence) of each edge seen from both ends; a self-loop once. Two equi-joinable
    halves instead of a join on either endpoint."""
    out = edges.select(F.col("src_key").alias("node"), F.col("dst_key").alias("other"), "kind", "confidence")
    back = edges.filter("src_key <> dst_key").select(F.col("dst_key").alias("node"), F.col("src_key").alias("other"), "kind", "confidence")
    return out.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, neighbours): edges at a node, and distinct other nodes."""
    return endpoints(edges).groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.count_distinct(F.when(F.col("node") != F.col("other"), F.col("other"))).alias("neighbours")
    )


def one_hop(edges: DataFrame, degree: DataFrame, anchor: DataFrame) -> DataFrame:
    """Edges at the one node of ``anchor`` (column root) with their relevance: the root's damping bounds the
    confidence weight, times the relation's weight and the other node's damping."""
    near = endpoints(edges).join(F.broadcast(anchor), F.col("node") == F.col("root"))  # one row
    d = degree.select(F.col("node").alias("_n"), F.col("degree").alias("_d"))
    root = d.join(F.broadcast(anchor), F.col("_n") == F.col("root"), "left_semi").select(F.col("_d").alias("root_degree"))
    scored = near.join(d, F.col("other") == F.col("_n")).crossJoin(F.broadcast(root))
    relevance = F.least(X.hub_damping(F.col("root_degree")), X.confidence_weight(F.col("confidence"))) * X.relation_weight(F.col("kind")) * X.hub_damping(F.col("_d"))
    return scored.select("root", "other", "kind", "confidence", X.round_score(relevance).alias("relevance"))


def distances(spark: SparkSession, edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(node, distance) of all nodes within ``depth`` hops of the ``sources`` (column node), either direction.

    Breadth-first rounds; each joins only the new frontier and drops what is known, and is written to the shared
    folder so that the plan does not grow.
    """
    scratch = Scratch(spark, "distances")
    ends = scratch.keep(endpoints(edges).select("node", "other").distinct())
    known = scratch.keep(sources.select("node").distinct().withColumn("distance", F.lit(0).cast("long")))
    frontier = known
    for step in range(1, depth + 1):
        new = ends.join(frontier.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
        frontier = scratch.keep(new.withColumn("distance", F.lit(step).cast("long")))
        known = known.unionByName(frontier)
    return known


def ends_table(edges: DataFrame, degree: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``endpoints`` with what scores an edge: confidence, relation weight, the other node's damping by its degree in
    the whole graph, and its role's penalty; src_key and dst_key give the direction.

    ``degree``: node, degree; ``roles``: node, role (none counts as production). This is the table to publish, sorted
    by node, that neighbourhoods are read from.
    """
    d = degree.select(F.col("node").alias("_n"), F.col("degree").alias("_d"))
    forward = edges.select(F.col("src_key").alias("node"), F.col("dst_key").alias("other"), "src_key", "dst_key", "kind", "confidence")
    back = edges.filter("src_key <> dst_key").select(F.col("dst_key").alias("node"), F.col("src_key").alias("other"), "src_key", "dst_key", "kind", "confidence")
    out = lookup_join(forward.unionByName(back), d, "other", "_n", "left")
    penalty = F.lit(1.0)
    if roles is not None:
        out = lookup_join(out.drop("_n"), roles.select(F.col("node").alias("_rn"), F.col("role").alias("_role")).dropDuplicates(["_rn"]), "other", "_rn", "left")
        penalty = X.role_penalty(F.col("_role"))
    return out.select(
        "node", "other", "src_key", "dst_key", "kind", "confidence", X.confidence_rank(F.col("confidence")).alias("rank"), X.confidence_weight(F.col("confidence")).alias("conf"),
        X.relation_weight(F.col("kind")).alias("rel"), X.hub_damping(F.coalesce("_d", F.lit(0))).alias("hub"), penalty.alias("part"),
    )


def resolved_anchors(wanted: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(anchor, tier, n_candidates, node_key): what each wanted anchor (column anchor) names.

    Tried in this order, the first that names anything decides: 1 an exact symbol key, 2 ``file:`` and a path, 3 a path
    or its end, 4 ``path:name``, 5 a symbol's name. node_key is set only if there is exactly one candidate; an anchor
    that names nothing has tier null and no candidates. Path ends are joined by equality with every end of every path.
    """
    parts = F.split("path", "/")
    ends = files.select(F.concat(F.lit("file:"), "path").alias("node_key"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("_a"))
    tier = lambda n, df: df.withColumn("_tier", F.lit(n))
    names = reduce(DataFrame.unionByName, [
        tier(1, symbols.select("node_key", F.col("node_key").alias("_a"))),
        tier(2, files.select(F.concat(F.lit("file:"), "path").alias("node_key")).withColumn("_a", F.col("node_key"))),
        tier(3, ends),
        tier(4, symbols.select("node_key", F.concat("path", F.lit(":"), "name").alias("_a"))),
        tier(5, symbols.select("node_key", F.col("name").alias("_a"))),
    ])
    asked = wanted.select("anchor").filter("anchor IS NOT NULL").distinct()
    per = asked.join(names, F.col("anchor") == F.col("_a")).groupBy("anchor", "_tier").agg(F.count(F.lit(1)).alias("_n"), F.min("node_key").alias("_k"))
    first = per.groupBy("anchor").agg(F.min(F.struct("_tier", "_n", "_k")).alias("_b"))
    return asked.join(first, "anchor", "left").select(
        "anchor", F.col("_b._tier").alias("tier"), F.coalesce("_b._n", F.lit(0)).alias("n_candidates"), F.when(F.col("_b._n") == 1, F.col("_b._k")).alias("node_key")
    )


#: An edge (source, target, kind, confidence), and the state of a reached node: depth and the floors of confidence,
#: relation, hub damping and role along the way.
Edge = tuple[str, str, str, str]
State = tuple[int, float, float, float, float]


def _score(state: State, conf: float, rel: float, hub: float, part: float) -> tuple[float, State]:
    d, c, r, h, p = state
    c, r, h, p = min(c, conf), min(r, rel), min(h, hub), min(p, part)
    return round(c * r * 0.75**d * h * p + 1e-12, 6), (d + 1, c, r, h, p)


class EdgeReader:
    """Edges of a published ``ends_table`` as a best-first search asks for them, a few nodes in one job.

    Of a node with its state only the ``most`` best edges in the search's own order come to the driver: more are never
    taken before the node limit, and after it only the edges among the reached nodes count, which ``among`` reads.
    """

    def __init__(self, spark: SparkSession, ends: DataFrame, least: str):
        self.spark = spark
        self.ends = ends.filter(F.col("rank") >= X.CONFIDENCE_RANK[least])
        self.jobs = 0

    def best(self, asked: list[tuple[str, State]], most: int) -> dict[tuple[str, State], list]:
        self.jobs += 1
        rows = [(k, n, d, c, r, h, p) for k, (n, (d, c, r, h, p)) in enumerate(asked)]
        want = F.broadcast(self.spark.createDataFrame(rows, "_k int, _node string, _sd int, _sc double, _sr double, _sh double, _sp double"))
        names = sorted({n for n, _ in asked})
        at = self.ends.filter(F.col("node").isin(names)).join(want, F.col("node") == F.col("_node"))
        power = F.pow(F.lit(0.75), F.col("_sd"))
        product = F.least("_sc", "conf") * F.least("_sr", "rel") * power * F.least("_sh", "hub") * F.least("_sp", "part")
        order = [F.round(product + 1e-12, 6).desc(), F.col("other"), "src_key", "dst_key", "kind", "confidence"]
        numbered = at.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter(F.col("_n") <= most)
        out: dict[tuple[str, State], list] = {a: [] for a in asked}
        for x in numbered.select("_k", "other", "src_key", "dst_key", "kind", "confidence", "conf", "rel", "hub", "part").collect():
            out[asked[x[0]]].append((x[1], (x[2], x[3], x[4], x[5]), x[6:]))
        return out

    def among(self, nodes: list[str]) -> dict[str, list]:
        """The edges whose ends are both of ``nodes``, by node; at most one of each kind for each pair."""
        self.jobs += 1
        out: dict[str, list] = {}
        rows = self.ends.filter(F.col("node").isin(nodes) & F.col("other").isin(nodes))
        for x in rows.select("node", "other", "src_key", "dst_key", "kind", "confidence", "conf", "rel", "hub", "part").collect():
            out.setdefault(x[0], []).append((x[1], (x[2], x[3], x[4], x[5]), x[6:]))
        return out


def neighborhood(
    reader, anchor: str, damping: float, depth: int = 1, node_limit: int = 50, edge_limit: int = 200,
) -> tuple[list[tuple[str, float, int]], list[tuple[Edge, float]]]:
    """Best-first neighbourhood of a node whose own hub damping is ``damping``.

    The frontier is ordered by score descending, depth, other node and edge. Each edge enters once; an edge to a
    new node beyond the node limit is skipped while edges between known nodes still enter; the edge limit ends
    the search. Relevance multiplies floors kept along the way: confidence, relation, hub damping and role, with
    0.75 for each further hop. Returns (node, relevance, depth) and (edge, relevance), best first.

    ``reader`` gives edges (see ``EdgeReader``). The search is replayed from the start whenever it needs a node not yet
    read; nodes that are next in the frontier are read with it, so jobs follow the depth and not the nodes. What
    comes to the driver is bounded by the limits: edge_limit times two of each node expanded, and the edges among
    the reached nodes.
    """
    read: dict[tuple[str, State], list] = {}
    inner: dict[str, list] | None = None
    start = (0, damping, 1.0, 1.0, 1.0)
    while True:
        missing: dict[tuple[str, State], None] = {}
        reached: dict[str, tuple[float, int]] = {anchor: (1.0, 0)}
        expanded: list[tuple[str, State]] = []
        taken: dict[Edge, float] = {}
        heap: list[tuple] = []
        full = False

        def push(node: str, state: State, edges: list) -> None:
            for other, e, attributes in edges:
                if e not in taken:
                    score, new = _score(state, *attributes)
                    heapq.heappush(heap, (-score, new[0], other, e, new))

        def expand(node: str, state: State) -> bool:
            if (node, state) not in read:
                missing[node, state] = None
                return False
            expanded.append((node, state))
            push(node, state, read[node, state])
            return True

        expand(anchor, start)
        while heap and len(taken) < edge_limit and not missing:
            neg, d, other, e, state = heapq.heappop(heap)
            if e in taken:
                continue
            if other not in reached and len(reached) >= node_limit:
                if not full:  # from here on only edges among the reached nodes enter, of all nodes expanded
                    full = True
                    if inner is None:
                        inner = reader.among(sorted(reached))
                    for node, s in expanded:
                        push(node, s, inner.get(node, []))
                continue
            taken[e] = -neg
            if other not in reached:
                reached[other] = (-neg, d)
                if d < depth and not expand(other, state):
                    break
        if not missing:
            break
        # the nodes that the frontier would reach next, each by its best edge
        ahead = dict.fromkeys(reached)
        for _, d, other, _, state in heapq.nsmallest(4 * node_limit, heap):
            if other not in ahead and d < depth and len(ahead) < node_limit:
                ahead[other] = None
                if (other, state) not in read:
                    missing[other, state] = None
        read |= reader.best(list(missing), 2 * edge_limit)
    found = sorted(((n, s, d) for n, (s, d) in reached.items()), key=lambda x: (-x[1], x[0]))
    return found, sorted(taken.items(), key=lambda x: (-x[1], x[0]))


def ranked_paths(scored: list[tuple[tuple, float]], start: str, goal: str, depth: int = 4, limit: int = 8, states: int = 50_000) -> list[tuple[float, list[str]]]:
    """Simple paths between two nodes over scored edges, the score of a path being its weakest edge.

    Depth-first, best edges first, at most ``states`` steps; best score first, then shorter, then by nodes.
    """
    at: dict[str, list[tuple[float, str]]] = {}
    for (a, b, *_), s in scored:
        at.setdefault(a, []).append((s, b))
        if a != b:
            at.setdefault(b, []).append((s, a))
    for x in at.values():
        x.sort(key=lambda t: (-t[0], t[1]))
    found: dict[tuple[str, ...], float] = {}
    left = states

    def walk(path: list[str], floor: float) -> None:
        nonlocal left
        if path[-1] == goal:
            key = tuple(path)
            found[key] = max(found.get(key, 0.0), floor)
            return
        if len(path) > depth:
            return
        for s, other in at.get(path[-1], ()):
            if left <= 0 or len(found) >= 32 * limit:
                return
            if other not in path:
                left -= 1
                walk([*path, other], min(floor, s))

    walk([start], float("inf"))
    return sorted(((s, list(p)) for p, s in found.items()), key=lambda x: (-x[0], len(x[1]), x[1]))[:limit]


def widest_paths(scored: list[tuple[tuple, float]], sources: list[str]) -> dict[str, tuple[float, str | None]]:
    """For each node the greatest weakest-edge score from any source and the predecessor on that path (the least
    of equals)."""
    at: dict[str, list[tuple[float, str]]] = {}
    for (a, b, *_), s in scored:
        at.setdefault(a, []).append((s, b))
        at.setdefault(b, []).append((s, a))
    best: dict[str, tuple[float, str | None]] = {}
    heap: list[tuple[float, str, str]] = [(-float("inf"), n, "") for n in sorted(sources)]
    while heap:
        neg, node, before = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (-neg, before or None)
        for s, other in at.get(node, ()):
            if other not in best:
                heapq.heappush(heap, (-min(-neg, s), other, node))
    return best
