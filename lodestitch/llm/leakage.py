"""Evaluation texts leaking into training text.

A hash set of the normalised n-grams of the test items is broadcast; training texts are scanned window by window
and hits are verified by aligning document and item words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

#: Words of a seed n-gram; of 20 words of which one in nine is altered, at least five in a row are unaltered.
SEED = 5
#: Least words of a leaked passage, and the greatest share of them that may be altered.
LEAST_WORDS = 20
ALTERED = 1 / 7
#: Words of test items in one broadcast; a larger set of items is scanned for in several passes, one block at a time.
BLOCK_WORDS = 2_000_000
#: A document of which more than this share leaked is removed whole.
MOST_LEAKED = 0.5

_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_NOT_WORD = re.compile(r"[^\w\s]+|_+")
#: Line markers of quotes, lists, comments, tables and listings at the start of a line.
_MARKER = re.compile(r"^[^\S\n]*(?:(?:[>|*+#•–—-]|//+|--+|/\*+|\*+/|\d{1,4}[.):|]|\[\d+\]|\(\d+\)|[a-z][.)]|[QA]:)[^\S\n]*)+(?=\s|\S)", re.M)


def normal_words(text: str) -> list[str]:
    """Words between blanks, in lower case and compatibility form, without punctuation, accents kept."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NOT_WORD.sub("", text.lower()).split()


def line_free(text: str) -> str:
    """The text without line markers."""
    return _MARKER.sub("", text)


@dataclass
class ItemIndex:
    """Words of the test items as numbers, with the numbers of shared sentences masked, and the seeds' places."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    item_of: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n word numbers."""
    if len(numbers) < n:
        return np.zeros(0, dtype=np.uint64)
    x = numbers.astype(np.uint64)
    h = np.zeros(len(x) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ (x[k : len(x) - n + 1 + k] * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return h


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, each as its normalised words joined by blanks."""
    return [" ".join(normal_words(s)) for s in _SENTENCE.split(text or "")]


def build_index(items: list[tuple[int, str]]) -> ItemIndex:
    """Index of (item id, text). Sentences that several items share are masked and take no part."""
    owners: dict[str, set[int]] = {}
    split = [(item, sentences(text)) for item, text in items]
    for item, parts in split:
        for s in parts:
            owners.setdefault(s, set()).add(item)
    return index_of((item, [(s, len(owners[s]) > 1) for s in parts]) for item, parts in split)


def index_of(items: Iterable[tuple[int, list[tuple[str, bool]]]]) -> ItemIndex:
    """Index of (item id, [(sentence, whether other items have it too)])."""
    index = ItemIndex()
    words: list[int] = []
    owner: list[int] = []
    for item, parts in items:
        for s, shared in parts:
            for w in s.split():
                # a masked word gets a number no document word has
                words.append(-1 if shared else index.vocabulary.setdefault(w, len(index.vocabulary) + 1))
                owner.append(item)
        words.append(-1)  # items do not run into each other
        owner.append(item)
    index.words = np.array(words, dtype=np.int64)
    index.item_of = np.array(owner, dtype=np.int64)
    hashes = window_hashes(index.words, SEED)
    clean = np.convolve(index.words < 0, np.ones(SEED), "valid") == 0 if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(clean)
    order = np.argsort(hashes[at], kind="stable")
    index.places, index.seeds = at[order], hashes[at][order]
    return index


def passages(words: list[str], index: ItemIndex) -> list[tuple[int, int, int]] | None:
    """(item, first word, last word) of the leaked passages of a document's normalised words; None if not even
    a seed occurs.

    Seeds on one diagonal, or on neighbouring ones where a word was split or joined, are chained over isolated
    altered words; a chain is a passage if it covers LEAST_WORDS item words, ends counted only where equal, and
    its altered share is within ALTERED.
    """
    if len(index.seeds) == 0 or len(words) < SEED:
        return None
    numbers = np.array([*map(index.vocabulary.get, words, repeat(0))], dtype=np.int64)
    # windows of known words alone can be seeds
    gaps = np.flatnonzero(numbers == 0)
    edges = np.concatenate(([-1], gaps, [len(numbers)]))
    if np.diff(edges).max() <= SEED:
        return None
    hashes = window_hashes(numbers, SEED)
    run = np.arange(len(numbers)) - edges[np.searchsorted(edges, np.arange(len(numbers)), side="right") - 1]
    at = np.flatnonzero(run[SEED - 1 :] >= SEED)
    lo = np.searchsorted(index.seeds, hashes[at], side="left")
    hi = np.searchsorted(index.seeds, hashes[at], side="right")
    hit = hi > lo
    if not hit.any():
        return None
    pairs: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(at[hit], lo[hit], hi[hit]):
        for p in index.places[a:b]:
            if (numbers[d : d + SEED] == index.words[p : p + SEED]).all():
                pairs.setdefault(int(index.item_of[p]), []).append((int(d), int(p)))
    out = []
    for item, seeds in pairs.items():
        out += [(item, a, b) for a, b in _chains(sorted(seeds), numbers, index)]
    return out


def _chains(seeds: list[tuple[int, int]], numbers: np.ndarray, index: ItemIndex) -> list[tuple[int, int]]:
    """Word ranges of the document covered by long enough chains of seeds of one item."""
    chains: list[list[int]] = []  # [first doc, first item, last doc, last item, altered]
    for d, p in seeds:
        placed = False
        for c in reversed(chains):
            gap_d, gap_p = d - c[2] - 1, p - c[3] - 1
            if p - d == c[3] - c[2] and d <= c[2] + 1:  # overlapping windows of one run
                c[2], c[3] = max(c[2], d + SEED - 1), max(c[3], p + SEED - 1)
                placed = True
                break
            if 0 <= gap_d <= 12 and 0 <= gap_p <= 12 and abs(gap_d - gap_p) <= 2:
                altered = _altered(numbers[c[2] + 1 : d], index.words[c[3] + 1 : p])
                if altered is not None:
                    c[2], c[3], c[4] = d + SEED - 1, p + SEED - 1, c[4] + altered
                    placed = True
                    break
        if not placed:
            chains.append([d, p, d + SEED - 1, p + SEED - 1, 0])
    out = []
    for c in chains:
        c = _stretched(c, numbers, index)
        length = c[3] - c[1] + 1
        if length >= LEAST_WORDS and c[4] <= length * ALTERED:
            out.append((c[0], c[2]))
    return out


def _altered(doc: np.ndarray, item: np.ndarray) -> int | None:
    """Altered words between two seeds if they stand alone (no two in a row, one split or joined), else None."""
    if (item < 0).any():
        return None
    if len(doc) == len(item):
        wrong = doc != item
        if (wrong[1:] & wrong[:-1]).any():
            return None
        return int(wrong.sum())
    # one word split or joined, or put in or left out: the parts before and after it must agree
    n = min(len(doc), len(item))
    same = 0
    while same < n and doc[same] == item[same]:
        same += 1
    tail = 0
    while tail < n - same and doc[len(doc) - 1 - tail] == item[len(item) - 1 - tail]:
        tail += 1
    rest = max(len(doc), len(item)) - same - tail
    return 1 if rest <= 3 else None


def _stretched(c: list[int], numbers: np.ndarray, index: ItemIndex) -> list[int]:
    """The chain with the equal words beyond isolated altered ones at both ends, where no whole seed fits."""
    first_d, first_p, last_d, last_p, altered = c
    words = index.words
    while last_d + 2 < len(numbers) and last_p + 2 < len(words):
        if words[last_p + 1] >= 0 and numbers[last_d + 1] == words[last_p + 1]:
            last_d, last_p = last_d + 1, last_p + 1
        elif words[last_p + 1] >= 0 and words[last_p + 2] >= 0 and numbers[last_d + 2] == words[last_p + 2]:
            last_d, last_p, altered = last_d + 2, last_p + 2, altered + 1
        else:
            break
    if last_d + 1 < len(numbers) and last_p + 1 < len(words) and words[last_p + 1] >= 0 and numbers[last_d + 1] == words[last_p + 1]:
        last_d, last_p = last_d + 1, last_p + 1
    while first_d >= 1 and first_p >= 1:
        if words[first_p - 1] >= 0 and numbers[first_d - 1] == words[first_p - 1]:
            first_d, first_p = first_d - 1, first_p - 1
        elif first_d >= 2 and first_p >= 2 and words[first_p - 1] >= 0 and words[first_p - 2] >= 0 and numbers[first_d - 2] == words[first_p - 2]:
            first_d, first_p, altered = first_d - 2, first_p - 2, altered + 1
        else:
            break
    return [first_d, first_p, last_d, last_p, altered]


def _blocks(spark: SparkSession, items: DataFrame, item_id: str) -> Iterator[ItemIndex]:
    """Indexes of about BLOCK_WORDS words or fewer, made one after the other; sharing is judged over all items."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, s) for i, text in zip(pdf[item_id], pdf["text"]) for n, s in enumerate(sentences(text))]
            yield pd.DataFrame(rows, columns=["item", "place", "sentence"])

    parts = items.filter(F.col(item_id).isNotNull() & (F.length("text") > 0)).select(item_id, "text").mapInPandas(
        split, f"item {items.schema[item_id].dataType.simpleString()}, place long, sentence string"
    )
    shared = parts.groupBy("sentence").agg(F.count_distinct("item").alias("_n")).filter("_n > 1").select("sentence", F.lit(True).alias("shared"))
    own = F.array_sort(F.collect_list(F.struct("place", "sentence", F.coalesce("shared", F.lit(False)).alias("shared"))))
    whole = Scratch(spark, "items").keep(parts.join(shared, "sentence", "left").groupBy("item").agg(own.alias("parts")))
    n_words = F.aggregate("parts", F.lit(0), lambda n, s: n + F.size(F.split(s["sentence"], " "))).alias("n")
    words = whole.select(F.sum(n_words)).first()[0] or 0
    n_blocks = 1 if words <= BLOCK_WORDS else -(-2 * words // BLOCK_WORDS)
    for block in range(n_blocks if words else 0):
        rows = whole.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect()
        if rows:
            yield index_of((r["item"], [(s["sentence"], s["shared"]) for s in r["parts"]]) for r in sorted(rows))


def leaked_passages(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Passages of ``items`` (item_id unique, text) in ``docs`` (doc_id, text).

    Each document is scanned whole, once with and once without its line markers; passages of one item that overlap
    are one. The items are a held-out set: their index is broadcast in blocks of about BLOCK_WORDS words, of which
    the driver holds one at a time, and sentences are compared for sharing across all items.

    Null and empty texts have no rows; an item shorter than the least passage cannot leak.
    Result: doc_id, item_id, first_word, last_word (of the document's words), n_words.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, doc_id), (items, item_id)))
    schema = f"{doc_id} {kind}, {item_id} {item_kind}, first_word long, last_word long, n_words long"
    scratch, out, waiting = Scratch(spark, "leaks"), [], None
    for index in _blocks(spark, items, item_id):
        if waiting is not None:  # more than one block: each pass is written before the next index is made
            out.append(scratch.keep(waiting))
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                found = []
                for d, text in zip(pdf[doc_id], pdf["text"]):
                    if text:
                        found += [(d, *f) for f in _scan_text(text, index)]
                frame = pd.DataFrame(found, columns=[doc_id, item_id, "first_word", "last_word"])
                frame["n_words"] = frame["last_word"] - frame["first_word"] + 1
                yield frame

        waiting = docs.select(doc_id, "text").mapInPandas(scan, schema)
    if waiting is None:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [*out, waiting])


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``docs`` that hold leaked passages, with these cut out: doc_id, text, n_words, n_removed, removed.

    The passages are those of ``leaked_passages``; from the first word of one to its last, the text between is cut
    too. Of a document of which more than MOST_LEAKED of the words leaked nothing is left (``removed``, text null).
    The text is cut where it is scanned, so no text is shuffled.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rest = docs.select(doc_id, "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"))
    for index in _blocks(spark, items, item_id):
        shared = spark.sparkContext.broadcast(index)

        def cut(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for d, text, n, gone in zip(pdf[doc_id], pdf["text"], pdf["n_words"], pdf["n_removed"]):
                    found = _scan_text(text, shared.value) if text else []
                    left, words, cut_words = without_words(text, [f[1:] for f in found]) if found else (text, 0, 0)
                    out.append((d, left, n or words, gone + cut_words))
                yield pd.DataFrame(out, columns=[doc_id, "text", "n_words", "n_removed"])

        rest = rest.mapInPandas(cut, f"{doc_id} {kind}, text string, n_words long, n_removed long")
    whole = F.col("n_removed") > MOST_LEAKED * F.col("n_words")
    return rest.filter("n_removed > 0").select(
        doc_id, F.when(~whole, F.col("text")).alias("text"), "n_words", "n_removed", whole.alias("removed")
    )


def without_words(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the words of the spans (first, last, counted as ``normal_words`` does), the number of its
    words, and of those cut. What stands between two cut words goes with them."""
    at, places = 0, []
    for m in re.finditer(r"\S+", text):
        n = len(normal_words(m.group()))
        places.append((at, at + n, m.start(), m.end()))
        at += n
    out, pos, gone = [], 0, 0
    for first, last in sorted(spans):
        inside = [p for p in places if p[0] <= last and p[1] > first and p[2] >= pos]
        if inside:
            out.append(text[pos : inside[0][2]])
            pos = inside[-1][3]
            gone += inside[-1][1] - inside[0][0]
    return "".join([*out, text[pos:]]), at, gone


def _scan_text(text: str, index: ItemIndex) -> list[tuple[int, int, int]]:
    """(item, first word, last word) of the passages with and without line markers, in the words of ``text``."""
    found = passages(normal_words(text), index) or []
    bare = line_free(text)  # markers in short lines break every seed, so this pass does not depend on the first
    if bare != text:
        more = passages(normal_words(bare), index) or []
        if more:
            at = _word_numbers(text)
            found += [(item, at[a], at[b]) for item, a, b in more]
    out: list[tuple[int, int, int]] = []
    for item, a, b in sorted(found):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((item, a, b))
    return out


def _word_numbers(text: str) -> list[int]:
    """For each word of the text without line markers its number among the words of the text."""
    out, start = [], 0
    for line in text.split("\n"):
        n, bare = len(normal_words(line)), len(normal_words(line_free(line)))
        out += range(start + n - bare, start + n)
        start += n
    return out
