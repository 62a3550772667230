"""Filling fixed-capacity containers by pattern packing with non-negative least squares.

The driver sees only the histogram of lengths (at most ``capacity`` entries, whatever the number of items). It
enumerates few-item length patterns that fill a container, adds deeper ones as the fit asks for them, fits their
repeat counts to the histogram by non-negative least squares, rounds them, and packs what is left. The result is a plan, runs of equal containers,
and items are matched with the plan's slots by their rank among the items of equal length.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import ranked
from ..session import Scratch

#: Length classes the patterns are made of, and the most items of the patterns that are enumerated at once.
CLASSES = 256
DEPTH = 2
#: The fit ends when no pattern of any number of items gains more than this share of what the best one gained at first.
OPTIMAL = 1e-4
#: Share of a pattern's repeats that is packed by it; the rest closes the gaps that the width of the classes leaves.
FITTED = 0.93


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """Counts per class (columns) of all multisets of at most ``depth`` classes that sum to ``classes``."""
    out: list[list[int]] = []

    def extend(parts: list[int], least: int, left: int) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for p in range(least, left + 1):
                if p == left or (len(parts) + 2 <= depth and left - p >= p):
                    extend([*parts, p], p, left - p)

    extend([], 1, classes)
    matrix = np.zeros((len(out), classes + 1))
    for row, parts in zip(matrix, out):
        for p in parts:
            row[p] += 1
    return matrix


def best_pattern(value: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """The multiset of classes, of whatever number, that sums to at most ``classes`` with the greatest total value.

    ``value`` is by class, from 0. An unbounded knapsack, exact; so its total bounds that of every pattern.
    """
    use = np.flatnonzero(value[1:] > 0) + 1
    best, last = np.zeros(classes + 1), np.zeros(classes + 1, dtype=np.int64)
    if len(use):
        worth = value[use]
        for room in range(1, classes + 1):
            n = int(np.searchsorted(use, room, side="right"))
            if n:
                total = best[room - use[:n]] + worth[:n]
                k = int(total.argmax())
                if total[k] > best[room - 1] + 1e-12:
                    best[room], last[room] = total[k], use[k]
                    continue
            best[room] = best[room - 1]
    counts, room = np.zeros(classes + 1), classes
    while room > 0:
        if last[room]:
            counts[last[room]] += 1
            room -= int(last[room])
        else:
            room -= 1
    return float(best[classes]), counts


def nnls(counts: np.ndarray, classes: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats): non-negative repeats of patterns that make the squared misfit to ``counts`` per class,
    weighted by the class, the least.

    The active-set method of Lawson and Hanson. What enters next is the best of the patterns ``start`` and of the
    deeper one that a knapsack over the residual gives; as that one bounds all patterns, the end is an optimum over
    all of them and not only over those enumerated.
    """
    weight = np.sqrt(np.arange(classes + 1))
    target = counts * weight
    active, x = np.zeros((0, classes + 1)), np.zeros(0)
    first = None
    while True:
        residual = target - (active * weight).T @ x
        gains = start @ (residual * weight) if len(start) else np.zeros(0)
        gain, pattern = best_pattern(residual * weight, classes)
        if len(gains) and gains.max() >= 0.8 * gain and not (active == start[gains.argmax()]).all(axis=1).any():
            gain, pattern = float(gains.max()), start[gains.argmax()]
        first = gain if first is None else first
        if gain <= OPTIMAL * max(first, 1e-9) or (active == pattern).all(axis=1).any():
            return active, x
        active, x = np.vstack((active, pattern)), np.append(x, 0.0)
        while True:
            a = (active * weight).T
            gram = a.T @ a
            s = np.linalg.lstsq(gram, a.T @ target, rcond=None)[0]
            if (s > 1e-9).all():
                x = s
                break
            low = np.flatnonzero(s <= 1e-9)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-12))
            x = x + min(step, 1.0) * (s - x)
            keep = x > 1e-9
            if keep.all():
                keep[low] = False
            active, x = active[keep], x[keep]
            if not len(x):
                return active, x


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a container, number of such containers) that use each length exactly as often as given.

    The size of the plan and of the work depends on the number of different lengths, not of items.
    """
    return _fill(*by_patterns(histogram, capacity, classes, depth), capacity)


def by_patterns(histogram: dict[int, int], capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """(runs, lengths left): the containers that fitted and rounded patterns fill, and what they leave."""
    left = {n: c for n, c in histogram.items() if c > 0}
    width = -(-capacity // classes)
    classes = -(-capacity // width)
    by_class: dict[int, list[int]] = {}
    for n in sorted(left):
        # the nearest class: what some items have more than their class, others have less
        by_class.setdefault(min(max(1, (n + width // 2) // width), classes), []).append(n)
    counts = np.zeros(classes + 1)
    for k, lengths in by_class.items():
        counts[k] = sum(left[n] for n in lengths)
    known = patterns(classes, depth)
    matrix, x = nnls(counts, classes, known[(known[:, counts == 0] == 0).all(axis=1)])
    opened: list[tuple[list[int], int]] = []  # (lengths, repeats)
    for j in np.argsort(-x, kind="stable"):
        repeats = int(round(x[j] * FITTED))
        parts = [k for k in range(classes, 0, -1) for _ in range(int(matrix[j, k]))]
        while repeats > 0:
            run = _take(parts, repeats, by_class, left, capacity)
            if run is None:
                break
            opened.append(run)
            repeats -= run[1]
    return opened, left


def _take(
    parts: list[int], most: int, by_class: dict[int, list[int]], left: dict[int, int], capacity: int
) -> tuple[list[int], int] | None:
    """The longest run of equal containers of a pattern: the greatest lengths left of its classes, lowered within
    their classes as far as they exceed the capacity together; what then still exceeds it is left out."""
    chosen: list[tuple[int, int]] = []  # (length, class)
    used: dict[int, int] = {}
    for k in parts:
        lengths = by_class.get(k, [])
        while lengths and not left.get(lengths[-1]):
            lengths.pop()
        n = next((m for m in reversed(lengths) if left.get(m, 0) > used.get(m, 0)), None)
        if n is None:
            return None
        chosen.append((n, k))
        used[n] = used.get(n, 0) + 1
    excess = sum(n for n, _ in chosen) - capacity
    for i, (n, k) in enumerate(chosen):
        if excess <= 0:
            break
        lower = [m for m in by_class[k] if m < n and left.get(m, 0) > used.get(m, 0)]
        if lower:
            at = bisect.bisect_right(lower, n - excess) - 1
            m = lower[at] if at >= 0 else lower[0]
            used[n] -= 1
            used[m] = used.get(m, 0) + 1
            chosen[i] = (m, k)
            excess -= n - m
    lengths = sorted(n for n, _ in chosen)
    while excess > 0:
        out = next((n for n in lengths if n >= excess), lengths[-1])
        lengths.remove(out)
        used[out] -= 1
        excess -= out
    if not lengths:
        return None
    repeats = min(most, *(left[n] // c for n, c in used.items() if c))
    for n, c in used.items():
        left[n] -= c * repeats
    return lengths, repeats


def _fill(opened: list[tuple[list[int], int]], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Residuals: runs with room take the greatest length left that fits; new containers open with the greatest
    length left. A run splits when a length does not suffice for all of its containers."""
    lengths = sorted(n for n, c in left.items() if c > 0)
    done: list[tuple[tuple[int, ...], int]] = []
    # fullest first, so that small items are not spent on large gaps that larger items could fill
    heap = [(capacity - sum(parts), k, parts, repeats) for k, (parts, repeats) in enumerate(opened)]
    heapq.heapify(heap)
    tick = len(heap)
    while heap or lengths:
        if heap:
            room, _, parts, repeats = heapq.heappop(heap)
        else:
            # no more containers than the rest can fill
            rest = -(-sum(n * left[n] for n in lengths) // capacity)
            room, parts, repeats = capacity, [], min(left[lengths[-1]], rest)
        at = bisect.bisect_right(lengths, room) - 1
        if at < 0:
            done.append((tuple(parts), repeats))
            continue
        n = _closing(lengths, at, room)
        at = bisect.bisect_left(lengths, n)
        each = min(room // n, left[n] // repeats)
        if each == 0:  # not enough for the whole run: split it
            some = left[n]
            heapq.heappush(heap, (room, tick, parts, repeats - some))
            each, repeats = 1, some
        elif len(lengths) > 1:
            each = min(each, max(1, (room // n) - 1)) if room % n else each
        left[n] -= each * repeats
        if left[n] == 0:
            lengths.pop(at)
        tick += 1
        heapq.heappush(heap, (room - each * n, tick, [*parts, *[n] * each], repeats))
    return done


def _closing(lengths: list[int], at: int, room: int) -> int:
    """The greatest length that fits, or one that together with a second fills the room better.

    Looks for a pair only when one item could nearly fill the room, where the choice decides what stays unused.
    """
    best, slack = lengths[at], room - lengths[at]
    if slack == 0 or room > 2 * lengths[-1]:
        return best
    for i in range(at, -1, -1):
        rest = room - lengths[i]
        if lengths[i] < rest:
            break
        k = bisect.bisect_right(lengths, rest) - 1
        gap = rest - lengths[k] if k >= 0 else rest
        if gap < slack:
            best, slack = lengths[i], gap
            if gap == 0:
                break
    return best


def pack(spark: SparkSession, sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Container of every item of ``sizes`` (key unique, size in tokens).

    An item above the capacity is cut into pieces of ``capacity`` tokens and a remainder; no other item is cut.
    Items of size 0 or null need no room and get no container. Pieces of equal length are interchangeable: they
    take the plan's slots in the order of key and piece.

    Result: key, piece (from 0), first_token, n_tokens, container_id (from 0, null for empty items).
    """
    scratch = Scratch(spark, "packing")
    pieces = _pieces(scratch.keep(sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))), key, capacity)
    histogram = _histogram(pieces)
    slots = spark.createDataFrame(_slots(plan(histogram, capacity)), "_len long, _first long, _count long, _base long")
    at, _ = ranked(spark, pieces.filter("n_tokens > 0").select("n_tokens", key, "piece"), "n_tokens", [F.col(key), F.col("piece")], [key, "piece"])
    numbered = at.select("n_tokens", F.col(key), "piece", F.col("before").alias("_rank"))
    # slots of one length are consecutive runs; an item finds its run by a join on length and rank range.
    # The table has a row per run and length of the plan, so its size follows the number of lengths alone.
    placed = numbered.join(
        F.broadcast(slots),
        (F.col("n_tokens") == F.col("_len")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")),
        "inner",
    ).select(
        key, "piece", (F.col("piece") * capacity).alias("first_token"), "n_tokens",
        (F.col("_base") + F.col("_rank") - F.col("_first")).alias("container_id"),
    )
    empty = pieces.filter("n_tokens <= 0").select(
        key, "piece", "first_token", "n_tokens", F.lit(None).cast("long").alias("container_id")
    )
    return placed.unionByName(empty)


def _pieces(items: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, first_token, n_tokens) of ``items`` (key, _size)."""
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("_size") / capacity) - 1))
    return items.select(key, "_size", F.explode(cuts).alias("piece")).select(
        key, "piece", (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).alias("n_tokens"),
    )


def _histogram(pieces: DataFrame) -> dict[int, int]:
    """Number of pieces of each length; at most as many rows as the capacity, whatever the number of items."""
    return {r[0]: r[1] for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}


def fill_summary(spark: SparkSession, sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """One row about ``pack``: containers, the least possible by size, share of the room used and of the tokens that
    fitted patterns placed."""
    items = sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    row = summary(_histogram(_pieces(items, key, capacity)), capacity)
    return spark.createDataFrame([row], "containers long, least_possible long, room_used double, by_patterns double")


def summary(histogram: dict[int, int], capacity: int) -> tuple[int, int, float, float]:
    """(containers, least number possible by size, share of the room used, share of the tokens placed by patterns)."""
    opened, left = by_patterns(histogram, capacity)
    total = sum(n * c for n, c in histogram.items())
    placed = sum(sum(parts) * r for parts, r in opened)
    boxes = sum(r for _, r in _fill(opened, left, capacity))
    return boxes, -(-total // capacity), total / (boxes * capacity) if boxes else 1.0, placed / total if total else 0.0


def _slots(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, number of ranks, first container) of each slot of each run."""
    used: dict[int, int] = {}
    out, base = [], 0
    for parts, repeats in runs:
        for n in parts:
            out.append((n, used.get(n, 0), repeats, base))
            used[n] = used.get(n, 0) + repeats
        base += repeats
    return out or [(0, 0, 0, 0)]
