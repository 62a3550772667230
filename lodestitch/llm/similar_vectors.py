"""Most similar vectors by cross-polytope hashing, with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a bucket compared in one task: larger buckets are cut into blocks, every block meeting every block.
BLOCK = 4096
#: At most so many vectors, over all profiles and for one, are sampled to plan the tables and to find hot buckets.
SAMPLE, SAMPLE_EACH = 24_576, 8_192
#: Profiles up to this size are compared as a whole; of larger ones the counts are estimated from one id in COUNTED.
SMALL, COUNTED = 2_048, 64
#: Bits of the sign code that candidates are compared by before the exact cosine, and the deviations left to it.
BITS, SLACK = 192, 3.5
#: Relative costs of a table entry and of a comparison by which a plan is chosen, and the most tables of a plan.
ENTRY, COMPARISON, TABLES = 3e-6, 3e-8, 48
#: Table numbers of the code's rotation and of the simulated tables.
CODE_TABLE, TRIAL_TABLE = 90_000, 91_000


@lru_cache(maxsize=8)
def _sylvester(n: int) -> np.ndarray:
    h = np.ones((1, 1), dtype=np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two, in steps of up to 16 at once."""
    n = x.shape[1]
    y, h = x, 1
    while h < n:
        step = min(16, n // h)
        y = np.matmul(_sylvester(step), y.reshape(len(x), n // (h * step), step, h)) if h > 1 else y.reshape(-1, step) @ _sylvester(step)
        h *= step
    return y.reshape(len(x), n) / np.float32(np.sqrt(n))


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotate(x: np.ndarray, table: int, level: int, rounds: int = 3) -> np.ndarray:
    """Pseudo-rotation: sign flips and Hadamard transforms, the flips drawn from the table and level numbers."""
    n = padded(x.shape[1])
    y = np.zeros((len(x), n), dtype=np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([table, level, n])
    for _ in range(rounds):
        y = hadamard(y * rng.choice(np.array([-1.0, 1.0], dtype=np.float32), n))
    return y


def nearest_keys(x: np.ndarray, table: int, axes: tuple[int, ...], probes: int) -> np.ndarray:
    """For each row the keys of its ``probes`` nearest buckets, nearest first.

    A key joins the nearest signed axes of one rotation for each entry of ``axes``, which says how many signed axes
    (of the first half as many coordinates) it has. A bucket's distance is the sum over the rotations of the
    squared shortfall of its axis. Without rotations there is one bucket.
    """
    keys, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1), dtype=np.float32)
    for level, n in enumerate(axes):
        y = rotate(x, table, level)[:, : n // 2]
        both = np.concatenate((y, -y), axis=1)
        m = min(n, probes)
        top = np.argpartition(-both, m - 1, axis=1)[:, :m]
        value = np.take_along_axis(both, top, axis=1)
        short = (value.max(axis=1, keepdims=True) - value) ** 2
        cost = (cost[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        keys = (keys[:, :, None] * n + top[:, None, :]).reshape(len(x), -1)
        m = min(probes, keys.shape[1])
        best = np.argpartition(cost, m - 1, axis=1)[:, :m]
        keys, cost = np.take_along_axis(keys, best, axis=1), np.take_along_axis(cost, best, axis=1)
    order = np.argsort(cost, axis=1, kind="stable")
    return np.take_along_axis(keys, order, axis=1)


@dataclass
class Plan:
    """Tables of a profile: signed axes of each rotation of a key, probes, tables, and the hot buckets' blocks."""

    axes: tuple[int, ...] = ()
    probes: int = 1
    tables: int = 1
    hot: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)


@lru_cache(maxsize=4096)
def _meetings(dim: int, cosine: float, axes: tuple[int, ...], probes: int) -> tuple[float, ...]:
    """Chance in one table that a vector's first 1, 2, ... probes meet the bucket of another at ``cosine``.

    Simulated with random pairs: after a random rotation the chance depends on nothing but the cosine.
    """
    rng = np.random.default_rng(dim)
    hits = np.zeros(probes)
    trials = 0
    for t in range(3):
        a, b = rng.normal(size=(2, 300, dim)).astype(np.float32)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b *= np.sqrt(max(0.0, 1 - cosine**2)) / np.linalg.norm(b, axis=1, keepdims=True)
        b += cosine * a
        looked, base = nearest_keys(a, TRIAL_TABLE + t, axes, probes), nearest_keys(b, TRIAL_TABLE + t, axes, 1)
        found = looked == base
        hits[: found.shape[1]] += found.sum(axis=0)
        trials += len(a)
    return tuple(np.minimum.accumulate(np.full(probes, 1.0)) * np.cumsum(hits) / trials)


def plan(dim: int, n: float, asked: float, sample: np.ndarray, cosine: float, recall: float) -> Plan:
    """The cheapest tables by which a pair at ``cosine`` of a profile of ``n`` vectors meets with chance ``recall``.

    Keys of up to three rotations, the last perhaps of fewer axes, are tried with up to 64 probes (32 if of several). The chance in one
    table is simulated, the number of candidates is estimated from the ``sample`` (distinct rows of the profile).
    Larger profiles so get longer keys, and the work grows slower than the square of the size.
    """
    if n <= SMALL:
        return Plan()
    full = 2 * padded(dim)
    last = [a for a in (8, 16, 32, 64, 128) if a < full] + [full]
    kinds = [(full,)] + [(full, a) for a in last] + [(full, full, a) for a in last]
    best, least = Plan(), math.inf
    known = sample[:1024]
    for axes in kinds:
        if math.prod(axes) > 4 * n and len(axes) > 1:
            continue
        most = 64 if len(axes) == 1 else 32
        looked = nearest_keys(known, TRIAL_TABLE, axes, most)
        bases, counts = np.unique(looked[:, 0], return_counts=True)
        at = np.minimum(np.searchsorted(bases, looked), len(bases) - 1)
        share = np.where(bases[at] == looked, counts[at], 0).mean(axis=0) / len(known)
        candidates = np.cumsum(np.maximum(share, 1 / math.prod(axes))) * n
        meet = _meetings(dim, cosine, axes, most)
        for probes in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64):
            if probes > len(candidates) or meet[probes - 1] <= 0.01:
                continue
            chance = min(meet[probes - 1], 0.999)
            tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))
            cost = tables * ((n + asked * (probes - 1)) * ENTRY + asked * candidates[probes - 1] * COMPARISON)
            if tables <= TABLES and cost < least:
                best, least = Plan(axes, probes, tables), cost
    for t in range(best.tables):
        keys, counts = np.unique(nearest_keys(sample, t, best.axes, 1)[:, 0], return_counts=True)
        for key, c in zip(keys, counts):
            size = c / len(sample) * n
            if c > 1 and size > BLOCK:
                best.hot[t, int(key)] = (math.ceil(size / BLOCK), math.ceil(size * asked / n * best.probes / BLOCK))
    return best


def usable_vectors(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """(vec_id, profile_id, vec) with one row per vec_id, scaled to unit length.

    Vectors that are null, of another length than the profile's dimensions, all zero or not finite are left out,
    as are those without a profile. Of repeated rows of an id the newest counts, ties by the vector.
    """
    dims = profiles.select(F.col("id").alias("_pid"), F.col("dimensions").cast("long").alias("_dim")).dropDuplicates(["_pid"])
    good = (
        vectors.select("vec_id", "profile_id", F.col("vec").cast("array<double>").alias("v"), "created_at")
        .join(F.broadcast(dims), F.col("profile_id") == F.col("_pid"), "inner")
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == F.col("_dim")))
        .filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .withColumn("_norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
        .filter((F.col("_norm") > 0) & (F.col("_norm") < float("inf")))
    )
    unit = F.transform("v", lambda x: (x / F.col("_norm")).cast("float"))
    return (
        good.groupBy("vec_id").agg(F.max(F.struct("created_at", "profile_id", unit.alias("vec"))).alias("_top"))
        .select("vec_id", "_top.profile_id", "_top.vec")
    )


def _plans(unit: DataFrame, asked: Column, k: int, least: float | None, recall: float) -> dict[int, Plan]:
    """Plan of each profile, from a bounded sample by id hash; profiles too small to be counted need none."""
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20))
    counted = unit.filter(hashed % COUNTED == 0).groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked"), F.max(F.size("vec")).alias("dim")
    ).collect()
    sizes = {r["profile_id"]: (r["n"] * COUNTED, r["asked"] * COUNTED, r["dim"]) for r in counted if r["n"] * COUNTED > SMALL}
    if not sizes:
        return {}
    each = max(256, min(SAMPLE_EACH, SAMPLE // len(sizes)))
    chosen = F.lit(False)
    for p, (n, _, _) in sizes.items():
        chosen = chosen | ((F.col("profile_id") == p) & (hashed < int((1 << 20) * min(1.0, each / n))))
    rows = unit.filter(chosen).select("profile_id", "vec").toPandas()
    out = {}
    for p, (n, n_asked, dim) in sizes.items():
        own = rows["vec"][rows["profile_id"] == p]
        sample = np.unique(np.stack(own.to_list()).astype(np.float32) if len(own) else np.zeros((0, dim), np.float32), axis=0)
        if not len(sample):
            continue
        sample = np.random.default_rng(5).permutation(sample)
        cosine = _usual(sample, n, k) if least is None else least
        out[p] = plan(dim, n, max(n_asked, 1), sample, round(cosine, 2), recall)
    return out


def _usual(sample: np.ndarray, n: float, k: int) -> float:
    """The cosine of the k-th neighbour that three vectors in four exceed, as the sample shows it."""
    some = sample[:400] @ sample.T
    np.fill_diagonal(some[:, : len(some)], -2)
    rank = max(1, round(k * len(sample) / n))
    kth = -np.partition(-some, min(rank - 1, some.shape[1] - 1), axis=1)[:, rank - 1]
    return float(np.clip(np.quantile(kth, 0.25), 0.05, 0.95))


def similar_vectors(
    spark: SparkSession, unit: DataFrame, k: int = 10, least: float | None = None, asked: Column | None = None, recall: float = 0.99,
) -> DataFrame:
    """(profile_id, vec_id, other_id, cosine, position): the ``k`` most similar vectors of each one's profile.

    ``unit`` is the result of ``usable_vectors``; ``asked`` is a condition on it that says whose neighbours are
    wanted (all by default). In each hash table a vector lies in the bucket of the nearest signed axes of one or
    more pseudo-rotations and looks into several buckets near it (see ``plan``: the number of rotations follows the
    profile's size, that of the tables the wanted ``recall``). A pair is aimed at if its cosine is ``least``, below
    which pairs are left out, or the usual one of a k-th neighbour. A bucket larger than BLOCK is cut into blocks,
    and every block of lookers meets every block of the bucket, so no task holds a whole hot bucket and no candidate
    is dropped.

    Table entries hold a code instead of the vector: its signs after a rotation if ``least`` is given, else its
    coordinates in a byte each. The best candidates by code get their exact cosine from the vectors. Equal vectors
    have one representative in the tables, which also tells its neighbours' k + 1 least ids, so copies are never
    compared with each other and still are each other's neighbours. Ties go to the lower id.
    A vector alone in its profile has no rows; neither has an empty table.
    """
    wanted = F.coalesce(F.lit(True) if asked is None else asked, F.lit(False))
    plans = _plans(unit, wanted, k, least, recall)
    # equal vectors have one key: two hashes of 96 bits in all
    key = F.concat_ws(":", "profile_id", F.xxhash64("vec"), F.hash("vec"))
    keyed = unit.select("vec_id", "profile_id", key.alias("key"), wanted.alias("_asked"))
    # the k + 1 least ids of each group of copies, in two steps so that no hot group is gathered
    order = Window.partitionBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    groups = (
        keyed.withColumn("_n", F.row_number().over(order)).withColumn("_low", F.when(F.col("_n") <= k + 1, F.col("vec_id")))
        .groupBy("key").agg(F.min("vec_id").alias("rep"), F.slice(F.array_sort(F.collect_set("_low")), 1, k + 1).alias("members"), F.bool_or("_asked").alias("_asked"))
    )
    # unit is partitioned by vec_id already, so its exchange serves here and for the exact cosines
    reps = unit.join(groups.select("rep", F.col("_asked").alias("_query")), F.col("vec_id") == F.col("rep"), "inner").select("profile_id", "rep", "vec", "_query")
    entries = reps.mapInPandas(_hasher(plans, least), f"bucket long, rep long, is_base boolean, is_query boolean, {_code_type(least)}")
    near = _exact(_candidates(entries, k, least), reps, k, least)
    # what a representative's neighbours stand for
    members = groups.select(F.col("rep").alias("_o"), F.col("members").alias("_m"))
    own = groups.filter("_asked AND size(members) > 1").select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine"))
    listed = near.unionByName(own).join(members, F.col("other") == F.col("_o"), "inner")
    per_rep = (
        listed.select("rep", "cosine", F.explode("_m").alias("other_id"))
        .groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other_id"))).alias("_near"))
        .select(F.col("rep").alias("_r"), F.slice("_near", 1, k * (k + 1) + k + 1).alias("_near"))
    )
    # representatives with neighbours, by key; rows of ids alone are joined, and those of a hot group of copies are
    # split by the adaptive skew join
    listed_keys = groups.select("rep", "key").join(per_rep, F.col("rep") == F.col("_r"), "inner").select(F.col("key").alias("_k"), "_near")
    mine = F.slice(F.filter("_near", lambda x: x["other_id"] != F.col("vec_id")), 1, k)
    floor = -2.0 if least is None else least
    return (
        keyed.filter("_asked").select("vec_id", "profile_id", "key").join(listed_keys, F.col("key") == F.col("_k"), "inner")
        .select("profile_id", "vec_id", F.posexplode(mine).alias("_at", "_x"))
        .select("profile_id", "vec_id", F.col("_x.other_id").alias("other_id"), (-F.col("_x.c")).alias("cosine"), (F.col("_at") + 1).alias("position"))
        .filter(F.col("cosine") >= floor)
    )


def _code_type(least: float | None) -> str:
    """Columns of a vector's code: its coordinates in a byte each, or BITS signs in longs."""
    return "code binary" if least is None else ", ".join(f"c{w} long" for w in range(BITS // 64))


def _codes(x: np.ndarray, least: float | None) -> dict[str, np.ndarray]:
    """The code columns: signs after a rotation, or coordinates scaled to a byte followed by the scale."""
    if least is None:
        top = np.abs(x).max(axis=1, keepdims=True)
        scaled = np.rint(x * (127 / top)).astype(np.int8).view(np.uint8)
        rows = np.concatenate((scaled, top.astype(np.float32).view(np.uint8)), axis=1)
        return {"code": np.array([r.tobytes() for r in rows], dtype=object)}
    turns = -(-BITS // padded(x.shape[1]))
    y = np.concatenate([rotate(x, CODE_TABLE, t) for t in range(turns)], axis=1)[:, :BITS]
    words = np.packbits(y > 0, axis=1).view(np.int64)
    return {f"c{w}": words[:, w] for w in range(words.shape[1])}


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit number from several."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, dtype=np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h.astype(np.int64)


def _hasher(plans: dict[int, Plan], least: float | None):
    """Table entries of vectors: the bucket it lies in and, for those asked about, the buckets it looks into."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (profile, _), part in pdf.groupby([pdf["profile_id"], pdf["vec"].map(len)]):
                p = plans.get(profile, Plan())
                x = np.vstack(part["vec"].to_numpy()).astype(np.float32)
                codes = _codes(x, least)
                rep, asked = part["rep"].to_numpy(), part["_query"].to_numpy(dtype=bool)
                for t in range(p.tables):
                    keys = nearest_keys(x, t, p.axes, p.probes)
                    yield from _table_entries(profile, t, keys, rep, asked, codes, p)

    return hashed


def _table_entries(profile: int, t: int, keys: np.ndarray, rep: np.ndarray, asked: np.ndarray, codes: dict[str, np.ndarray], p: Plan) -> Iterator[pd.DataFrame]:
    hot = np.isin(keys, [key for at, key in p.hot if at == t]) if p.hot else np.zeros(keys.shape, dtype=bool)
    rows, cols = np.nonzero(~hot & (asked[:, None] | (np.arange(keys.shape[1]) == 0)[None, :]))
    yield pd.DataFrame({
        "bucket": _mixed(profile, t, keys[rows, cols], 0, 0), "rep": rep[rows], "is_base": cols == 0, "is_query": asked[rows],
        **{n: v[rows] for n, v in codes.items()},
    })
    out = []
    for i, j in zip(*np.nonzero(hot)):
        nb, nq = p.hot[t, int(keys[i, j])]
        part = int(_mixed(int(rep[i]), 1)) % (1 << 31)
        if j == 0:
            out += [(keys[i, j], part % nb, q, i, True, False) for q in range(nq)]
        if asked[i]:
            out += [(keys[i, j], b, part % nq, i, False, True) for b in range(nb)]
    if out:
        key, b, q, i, base, query = map(np.array, zip(*out))
        yield pd.DataFrame({"bucket": _mixed(profile, t, key, b + 1, q + 1), "rep": rep[i], "is_base": base, "is_query": query, **{n: v[i] for n, v in codes.items()}})


def _candidates(entries: DataFrame, k: int, least: float | None) -> DataFrame:
    """(rep, other, near): the best candidates by code of all buckets each representative looks into."""
    parted = entries.repartition("bucket").sortWithinPartitions("bucket")
    found = parted.mapInPandas(_comparer(k, least), "rep long, other long, near double")
    if least is not None:
        return found
    # a representative has at most tables x probes x blocks x 2k rows here
    once = found.groupBy("rep", "other").agg(F.max("near").alias("near"))
    best = Window.partitionBy("rep").orderBy(F.col("near").desc(), "other")
    return once.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= 2 * k).drop("_n")


def _comparer(k: int, least: float | None):
    """Candidates of the buckets of a partition sorted by bucket, whole buckets at a time."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if rest and rest[-1]["bucket"].iloc[-1] == pdf["bucket"].iloc[-1]:
                rest.append(pdf)  # one bucket goes on
                continue
            start = int(np.searchsorted(pdf["bucket"].to_numpy(), pdf["bucket"].iloc[-1]))
            yield _met(pd.concat([*rest, pdf.iloc[:start]]), k, least)
            rest = [pdf.iloc[start:]]
        if rest:
            yield _met(pd.concat(rest), k, least)

    return compared


def _met(rows: pd.DataFrame, k: int, least: float | None) -> pd.DataFrame:
    """Pairs of the lookers of each bucket with the best of those that lie in it."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    # byte codes are of one length but for profiles of different dimensions
    for _, part in rows.groupby(rows["code"].map(len), sort=False) if least is None else [(0, rows)]:
        ids = part["rep"].to_numpy()
        base, query = np.flatnonzero(part["is_base"]), np.flatnonzero(part["is_query"])
        bucket = part["bucket"].to_numpy()
        lo, hi = (np.searchsorted(bucket[base], bucket[query], side=s) for s in ("left", "right"))
        if least is None:
            codes = np.frombuffer(b"".join(part["code"]), dtype=np.uint8).reshape(len(part), -1)
            values = codes[:, :-4].view(np.int8).astype(np.float32) * (np.ascontiguousarray(codes[:, -4:]).view(np.float32) / 127)
        else:
            values = np.stack([part[f"c{w}"].to_numpy() for w in range(BITS // 64)], axis=1).view(np.uint64)
        upto = np.concatenate(([0], np.cumsum(hi - lo)))
        at = 0
        while at < len(query):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + 400_000, side="right")) - 1)
            n = hi[at:end] - lo[at:end]
            looker = np.repeat(np.arange(at, end), n)
            other = np.arange(upto[end] - upto[at]) - np.repeat(upto[at:end] - upto[at], n) + np.repeat(lo[at:end], n)
            q, b = query[looker], base[other]
            q, b, looker = (z[ids[q] != ids[b]] for z in (q, b, looker))
            if least is None:
                near = np.einsum("ij,ij->i", values[q], values[b])
            else:
                bits = values.shape[1] * 64
                p = math.acos(min(1.0, least)) / math.pi
                differ = sum(np.bitwise_count(values[q, w] ^ values[b, w]).astype(np.int64) for w in range(values.shape[1]))
                ok = differ <= bits * p + SLACK * math.sqrt(bits * p * (1 - p))
                q, b, looker, near = q[ok], b[ok], looker[ok], -differ[ok].astype(float)
            keep = _foremost(looker, near, ids[b], 2 * k if least is None else 4 * k)
            out.append((ids[q[keep]], ids[b[keep]], near[keep]))
            at = end
    rep, other, near = (np.concatenate(z) for z in zip(*out))
    return pd.DataFrame({"rep": rep, "other": other, "near": near.astype(float)})


def _foremost(group: np.ndarray, value: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the ``most`` greatest values of each group (sorted ascending), ties to the lower."""
    if not len(group) or np.bincount(group - group[0]).max() <= most:
        return np.arange(len(group))
    order = np.lexsort((tie, -value, group))
    first = np.searchsorted(group, group[order])
    return order[np.arange(len(order)) - first < most]


def _exact(candidates: DataFrame, reps: DataFrame, k: int, least: float | None) -> DataFrame:
    """(rep, other, cosine): the ``k`` best of each representative asked about, by the cosine of the vectors."""
    pairs = candidates.select(F.least("rep", "other").alias("_a"), F.greatest("rep", "other").alias("_b")).distinct()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, t: s + t.cast("double") * t.cast("double")))
    side = lambda n: reps.select(F.col("rep").alias(f"_{n}"), F.col("vec").alias(f"_v{n}"), norm.alias(f"_n{n}"), F.col("profile_id").alias(f"_p{n}"), F.col("_query").alias(f"_q{n}"))
    both = pairs.join(side("a"), "_a").join(side("b"), "_b").filter("_pa = _pb")
    dot = F.aggregate(F.zip_with("_va", "_vb", lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    scored = both.select("_a", "_b", "_qa", "_qb", F.round(dot / (F.col("_na") * F.col("_nb")), 9).alias("cosine"))
    if least is not None:
        scored = scored.filter(F.col("cosine") >= least)
    ways = F.explode(F.array(F.struct(F.col("_a").alias("rep"), F.col("_b").alias("other"), F.col("_qa").alias("q")), F.struct(F.col("_b").alias("rep"), F.col("_a").alias("other"), F.col("_qb").alias("q"))))
    best = Window.partitionBy("rep").orderBy(F.col("cosine").desc(), "other")
    return (
        scored.select("cosine", ways.alias("_w")).filter("_w.q").select("_w.rep", "_w.other", "cosine")
        .withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")
    )
