"""Generated, minified, vendored and data files among source files.

A random forest learns, from features of the text, to tell machine-written files from hand-written ones. Its
labels are notices in the header comment, which the features do not see. Copies of third-party files read like
hand-written code, so no text statistic tells them; they are found by their word shingles' similarity with the
files of the dependencies.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import Scratch
from . import forest

#: Names of the features, in order.
FEATURES = [
    "compression_ratio", "token_entropy", "identifier_length", "short_identifiers", "comment_density", "line_length",
    "longest_line", "blank_share", "literal_share", "line_shapes", "distinct_identifiers", "size", "word_share",
]
#: At most so many labelled rows are learnt from: those whose ids hash lowest.
SAMPLE = 20_000
#: Votes of the forest from which a file counts as machine-written, and from which a text without a notice is taken
#: out of the negatives before the next fit: most machine-written files bear no notice, so few votes are a doubt.
THRESHOLD, DOUBT, CLEANINGS = 0.5, 0.05, 2
TREES, DEPTH, SEED = 60, 8, 11

#: Shingle length in words and the least share of the smaller file's shingles that a copy shares with its original.
SHINGLE, ALIKE = 5, 0.8
#: The least share of the repository's file itself: a file is judged as a whole, so one that is for the greater part
#: something else is no copy, whatever small third-party file it holds. A truncated copy is not touched by this.
WHOLE = 0.4
#: Places for each shingle of the dependencies in the table of how frequent they are, by which shingles are ordered, and
#: in the table of marks (a bit a place) by which those no dependency has are left out, each with the greatest size
#: as a power of 2: 16 and 128 MB. Full tables only let more through. Tables are built and sent in pieces of SLICE bytes.
PLACES, PLACES_MOST, MARKS, MARKS_MOST, SLICE = 2, 24, 8, 30, 1 << 22

#: What generators write into the header (fixed values).
NOTICES = re.compile(
    r"@generated|auto-?generated|(?:automatically|code|file was|file is|machine)\s+generated|machine output|generated by"
    r"|(?:automatisch|maschinell)\b.{0,60}\b(?:erzeugt|generiert)|produit par|généré (?:par|automatiquement)"
    r"|generado (?:por|automáticamente)|gerado (?:por|automaticamente)|wygenerowan|сгенерирован"
    r"|do not edit|nicht bearbeiten|ne pas modifier|edits are overwritten|changes will be lost|regenerate instead",
    re.I,
)
#: Signs that a person speaks about generated files, not a generator about its own (fixed values).
SPEAKS_ABOUT = re.compile(r"by hand|written and kept|kept by|hand-?written|['\"`][^'\"`\n]*(?:generated|do not edit)[^'\"`\n]*['\"`]", re.I)
BANNER = re.compile(r"/\*!")

_HEAD = re.compile(r"(?:\s+|#![^\n]*|['\"]use strict['\"];?|//[^\n]*|/\*(?s:.*?)\*/)*+")
_COMMENT = re.compile(r"//[^\n]*|/\*(?s:.*?)\*/")
_TOKEN = re.compile(
    r"[^\W\d][\w$]*+|[^\s\w'\"`/$]|\d[\w.]*+|'(?:[^'\\\n]++|\\(?s:.))*+'|\"(?:[^\"\\\n]++|\\(?s:.))*+\"|`(?:[^`\\]++|\\(?s:.))*+`"
    r"|//[^\n]*+|/\*(?s:.*?)\*/|(?:(?<=[(,=:!&|?;\[{])|(?<=[(,=:!&|?;\[{] ))/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
    r"|\$[\w$]*|[^\s\w]"
)
_CONFLICT = re.compile(r"^(?:<{7} .*\n(?s:.*?)^>{7}.*\n?)", re.M)
_NAME_BYTES = bytes(b for b in range(256) if b > 127 or chr(b).isalnum() or chr(b) in "_$")
_WORD = re.compile(r"\w+")


_WORD_START = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")


def head_comment(text: str) -> tuple[str, str]:
    """The comments before the first code, and the rest."""
    m = _HEAD.match(text)
    return text[: m.end()], text[m.end() :]


def notice(text: str) -> str | None:
    """generated, banner or None, from the header comment (a conflict block before it aside)."""
    head, _ = head_comment(_CONFLICT.sub("", text, count=1) if "<<<<<<<" in text else text)
    if not head or head.isspace():
        return None
    comments = "\n".join(_COMMENT.findall(head))
    if NOTICES.search(comments) and not SPEAKS_ABOUT.search(comments):
        return "generated"
    return "banner" if BANNER.search(comments) else None


def features(text: str) -> list[float]:
    """The FEATURES of a text without its header comment."""
    _, body = head_comment(_CONFLICT.sub("", text) if "<<<<<<<" in text else text)
    comment_chars = literal_chars = word_chars = n_tokens = n_words = n_distinct = short = 0
    surprise = 0.0  # sum of n log2 n over the distinct tokens
    for t, n in Counter(_TOKEN.findall(body)).items():
        c = t[0]
        if c in _WORD_START or c.isalpha():
            size = len(t)
            word_chars += n * size
            n_words += n
            n_distinct += 1
            if size <= 2:
                short += n
        elif c == "/" and len(t) > 1:
            if t[1] in "/*":
                comment_chars += n * len(t.rstrip())
                continue
            literal_chars += n * len(t)
        elif c in "'\"`" and len(t) > 1 or c.isdigit():
            literal_chars += n * len(t)
        n_tokens += n
        if n > 1:
            surprise += n * math.log2(n)
    code = _COMMENT.sub("", body) if comment_chars else body
    data = code.encode("utf-8", "surrogatepass")
    entropy = math.log2(n_tokens) - surprise / n_tokens if n_tokens else 0.0
    lines = [x for x in code.split("\n") if x and not x.isspace()]
    # the shape of a line is what stays without its names and numbers
    shapes = set(map(bytes.strip, data.translate(None, _NAME_BYTES).split(b"\n")))
    size = max(len(code), 1)
    return [
        len(zlib.compress(data, 1)) / max(len(data), 1), entropy, word_chars / max(n_words, 1),
        short / max(n_words, 1), comment_chars / max(len(body), 1), sum(map(len, lines)) / max(len(lines), 1),
        math.log1p(max(map(len, lines), default=0)), sum(map(code.count, " \t\n")) / size, literal_chars / size,
        len(shapes) / max(len(lines), 1), n_distinct / max(n_words, 1), math.log1p(size), word_chars / size,
    ]


_LITERAL = re.compile(r"\s*(?:export\s+default\s*|module\.exports\s*=\s*)?([\[{'\"`])")
_BARE = re.compile(r"'(?:[^'\\\n]++|\\(?s:.))*+'|\"(?:[^\"\\\n]++|\\(?s:.))*+\"|`(?:[^`\\]++|\\(?s:.))*+`|//[^\n]*|/\*(?s:.*?)\*/|[\d.eExXA-Fa-f_+-]*\d[\d.eExXA-Fa-f_+-]*|\b(?:true|false|null)\b|[\s,:;\[\]{}()]+")
#: A literal shorter than this is something a person may have typed.
LEAST_DATA = 600


def is_data(text: str) -> bool:
    """Whether the whole text is one literal (an array, an exported object or string) of some size.

    A bare object is no ECMAScript file but text of another language, so it does not count.
    """
    _, body = head_comment(_CONFLICT.sub("", text) if "<<<<<<<" in text else text)
    m = _LITERAL.match(body)
    if m is None or len(body) < LEAST_DATA:
        return False
    exported = body[m.start() : m.start(1)].strip()
    if not exported and m[1] != "[":
        return False
    rest = _BARE.sub("", body[m.start(1) :])
    return len(rest) <= 0.02 * len(body)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class _Codes(dict):
    """Checksum of each word, remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code


_CODES = _Codes()


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of SHINGLE words. Many short texts are hashed at once."""
    for at in range(0, len(texts), 256):
        words = [_WORD.findall(t) for t in texts[at : at + 256]]
        ids = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(words)), dtype=np.uint64)
        n = max(len(ids) - SHINGLE + 1, 0)
        h = ids[:n].copy()
        with np.errstate(over="ignore"):
            for k in range(1, SHINGLE):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += ids[k : k + n]
        h, start = _mix(h, 1), 0
        for own in words:
            part = np.sort(h[start : start + max(len(own) - SHINGLE + 1, 0)])
            if len(part) > 1:
                new = np.empty(len(part), dtype=bool)
                new[0] = True
                np.not_equal(part[1:], part[:-1], out=new[1:])
                part = part[new]
            yield part
            start += len(own)


def _at(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of shingles in a table of 2 ** bits counts."""
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _merged(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, bytes]:
    """Two packed pieces of one table: marks (1) of either, or counts (0) added up to 255."""
    x, y = (np.frombuffer(zlib.decompress(z), np.uint8) for _, z in (a, b))
    return a[0], zlib.compress((x | y if a[0] else x + np.minimum(y, 255 - x)).tobytes(), 1)


#: A table of counts and one of marks, packed: their sizes as powers of 2, and the pieces that are not empty by table and place.
Packed = tuple[tuple[int, int], dict[tuple[int, int], bytes]]


def frequencies(originals: DataFrame) -> Packed:
    """By place, about how many ``originals`` have a shingle there, never 0 for one they have; and marks of those they have."""
    total = originals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits, mark_bits = (min(max(16, math.ceil(math.log2(p * total + 1))), most) for p, most in ((PLACES, PLACES_MOST), (MARKS, MARKS_MOST)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = np.zeros(1 << bits, dtype=np.uint8), np.zeros(1 << (mark_bits - 3), dtype=np.uint8)
        for pdf in batches:
            if not pdf["n"].sum():
                continue
            hashes = np.sort(np.concatenate(pdf["shingles"].to_list()).astype(np.int64).view(np.uint64))
            at, n = np.unique(_at(hashes, bits), return_counts=True)
            tables[0][at] = np.minimum(tables[0][at] + n, 255)
            at = _at(hashes, mark_bits)
            first = np.flatnonzero(np.diff(at >> 3, prepend=-1))
            tables[1][at[first] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)
        for kind, whole in enumerate(tables):
            for lo in range(0, len(whole), SLICE):
                if whole[lo : lo + SLICE].any():
                    yield pd.DataFrame({"kind": [kind], "lo": [lo], "piece": [zlib.compress(whole[lo : lo + SLICE].tobytes(), 1)]})

    pieces = originals.select("n", "shingles").mapInPandas(count, "kind int, lo long, piece binary").rdd
    merged = pieces.map(lambda r: ((r[0], r[1]), (r[0], bytes(r[2])))).reduceByKey(_merged).collect()
    return (bits, mark_bits), {key: piece for key, (_, piece) in merged}


def unpacked(packed: Packed) -> tuple[np.ndarray, np.ndarray]:
    """The tables of counts and of marks."""
    (bits, mark_bits), pieces = packed
    tables = np.zeros(1 << bits, dtype=np.uint8), np.zeros(1 << (mark_bits - 3), dtype=np.uint8)
    for (kind, lo), piece in pieces.items():
        part = np.frombuffer(zlib.decompress(piece), np.uint8)
        tables[kind][lo : lo + len(part)] = part
    return tables


def _rare_first(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted hashes in the one order in which all texts have their shingles: by count, then by hash."""
    return hashes[np.argsort(counts[_at(hashes, len(counts).bit_length() - 1)], kind="stable")]


def probes(hashes: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> tuple[int, np.ndarray]:
    """(hits, probes): how many shingles of a text the dependencies may have, and of these, the rare first, all but
    the least number to share less one, and FURTHER more: a dependency's file that shares WHOLE of the text's has as
    many of them and one."""
    at = _at(hashes, len(marks).bit_length() + 2)
    own = hashes[(marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
    wanted = len(own) - math.ceil(WHOLE * len(hashes)) + 1
    if wanted <= 0 or not len(own):
        return len(own), own[:0]
    return len(own), _rare_first(own, counts)[: wanted + FURTHER]


def _originals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [h.view(np.int64) for h in shingle_sets([text or "" for text in pdf["content"]])]
        yield pd.DataFrame({"rep": pdf["rep"], "n": [len(h) for h in found], "shingles": found})


def _is_copy(own: np.ndarray, original: np.ndarray) -> bool:
    """Whether of two sets of shingles the first is a copy of the second, perhaps altered or truncated."""
    common = len(np.intersect1d(own, original, assume_unique=True))
    return common > 0 and common >= ALIKE * min(len(own), len(original)) and common >= WHOLE * len(own)


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        copies: set[int] = set()
        known: dict[int, np.ndarray] = {}
        for rep, third, own, original in zip(pdf["rep"], pdf["third_rep"], pdf["own_text"], pdf["third_text"]):
            if rep in copies:
                continue
            for key, text in (rep, own), (third, original):
                if key not in known:
                    known[key] = next(shingle_sets([text]))
            if _is_copy(known[rep], known[third]):
                copies.add(rep)
        yield pd.DataFrame({"rep": sorted(copies)}, dtype="int64")


def machine_written(spark: SparkSession, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, probability, is_copy, is_data, found) of every file whose origin is not ``dependency``.

    ``files``: id, path, origin; ``sources``: file_id, content. Case and blanks of the origin do not count; a null
    origin is the repository's own. Equal texts are judged once. ``found`` is set if the forest's ``probability``
    reaches THRESHOLD, or if the file is a copy: ALIKE of the word shingles of the smaller
    and WHOLE of its own are shared with a file of a dependency. Null and empty contents are never found. The forest is fitted on at most SAMPLE labelled texts:
    files with a generator's notice or a bundler's banner, and data literals, against those without any; after
    each of CLEANINGS fits the texts without a notice that got DOUBT or more are left out of the negatives. With
    no positive or no negative text there is no forest and the probability is 0.
    """
    scratch = Scratch(spark, "handwritten")
    third = F.lower(F.trim(F.coalesce(F.col("origin"), F.lit("repository")))) == "dependency"
    read = sources.select(F.col("file_id").alias("_sid"), "content")
    text = F.coalesce("content", F.lit(""))
    # texts are told apart by two hashes, 96 bits in all, and their length; only these are joined with the files
    known = read.select("_sid", F.concat_ws(":", F.xxhash64(text), F.hash(text), F.length(text)).alias("key"), F.length(text).alias("size"))
    hashed = scratch.keep(
        files.select(F.col("id").alias("file_id"), third.alias("third")).join(known, F.col("file_id") == F.col("_sid"), "inner")
        .select("file_id", "third", F.concat_ws(":", "key", F.col("third").cast("string")).alias("digest"), "size")
    )
    # of equal texts the file of the least id stands for all; its text is shuffled once, to here
    reps = scratch.keep(hashed.groupBy("digest", "third").agg(F.min("file_id").alias("rep")))
    texts = scratch.keep(
        read.join(reps.select("rep", "third"), F.col("_sid") == F.col("rep"), "inner").select("rep", "third", "content").dropDuplicates(["rep"])
    )
    originals = scratch.keep(texts.filter("third").select("rep", "content").mapInPandas(_originals, "rep long, n long, shingles array<long>"))
    shared = spark.sparkContext.broadcast(frequencies(originals))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, marks = unpacked(shared.value)
        for pdf in batches:
            out = []
            texts = [text or "" for text in pdf["content"]]
            for rep, text, own in zip(pdf["rep"], texts, shingle_sets(texts)):
                hits, rare = probes(own, counts, marks)
                out.append((rep, notice(text), is_data(text), features(text), len(own), hits, rare.view(np.int64)))
            yield pd.DataFrame(out, columns=["rep", "notice", "is_data", "features", "n", "hits", "probes"])

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, _ = unpacked(shared.value)
        for pdf in batches:
            yield pdf.assign(shingles=[_rare_first(np.asarray(h, dtype=np.int64), counts) for h in pdf["shingles"]])

    described = scratch.keep(
        texts.filter("NOT third").select("rep", "content").mapInPandas(
            describe, "rep long, notice string, is_data boolean, features array<double>, n long, hits long, probes array<long>"
        )
    )
    copies = _copies(scratch, texts, described, originals.mapInPandas(ordered, originals.schema))
    own = described.join(copies.withColumn("is_copy", F.lit(True)), "rep", "left").select(
        "rep", "notice", "is_data", "features", F.coalesce("is_copy", F.lit(False)).alias("is_copy")
    )
    judged = _judged(spark, scratch.keep(own))
    found = (F.col("probability") >= THRESHOLD) | F.col("is_copy")
    known = reps.select(F.col("digest").alias("_digest"), "rep").join(judged, "rep", "inner")
    return lookup_join(hashed.filter("NOT third"), known, "digest", "_digest").select(
        "file_id", F.round("probability", 6).alias("probability"), "is_copy", "is_data", (found & (F.col("size") > 0)).alias("found")
    )


#: Probes beyond the least number by which candidates are sifted before their texts are compared.
FURTHER = 8


def _copies(scratch: Scratch, texts: DataFrame, described: DataFrame, originals: DataFrame) -> DataFrame:
    """(rep): own texts that are copies of a dependency's file.

    Both sides are distinct texts, so copies of one text meet once; both have their shingles in one order, the rare
    first. Two texts that share ``least`` shingles share 1 + ``more`` of those that are left when of either the last
    ``least`` - 1 - ``more`` are taken off. Common shingles so stay out of the join on both sides: an original not larger than the own
    text must be shared for ALIKE of its own, so only the rare rest of it and FURTHER are looked up; with a larger one
    the same is true of the own text, so the two cases are joined apart (``_larger``). Candidates left are compared
    by all their shingles.
    """
    share = lambda n: F.ceil(n * ALIKE)
    of_larger = (share(F.col("n")) <= F.col("hits")) & (F.col("_at") <= F.col("hits") - share(F.col("n")) + FURTHER)
    probed = described.select("rep", "n", "hits", F.posexplode("probes").alias("_at", "shingle")).withColumn(
        "_larger", F.explode(F.when(of_larger, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    )
    rare = F.col("_to") <= F.col("_n") - share(F.col("_n")) + FURTHER
    original = originals.select(F.col("rep").alias("third_rep"), F.col("n").alias("_n"), F.posexplode("shingles").alias("_to", "_s")).withColumn(
        "_l", F.explode(F.when(rare, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True))))
    )
    least = F.greatest(F.ceil(F.col("n") * WHOLE), share(F.least("n", "_n")))
    more = F.least(F.lit(FURTHER), least - 1)
    pairs = scratch.keep(
        probed.join(original, (F.col("shingle") == F.col("_s")) & (F.col("_larger") == F.col("_l")), "inner")
        .filter((F.col("_larger") == (F.col("_n") > F.col("n"))) & (least <= F.col("_n")) & (least <= F.col("hits")))
        .filter((F.col("_at") <= F.col("hits") - least + more) & (F.col("_to") <= F.col("_n") - least + more))
        .groupBy("rep", "third_rep").agg(F.count(F.lit(1)).alias("_shared"), F.any_value(more).alias("_more"))
        .filter("_shared > _more").select("rep", "third_rep")
    )
    own_text = texts.filter("NOT third").select("rep", F.col("content").alias("own_text"))
    third_text = texts.filter("third").select(F.col("rep").alias("third_rep"), F.col("content").alias("third_text"))
    return scratch.keep(
        pairs.join(own_text, "rep", "inner").join(third_text, "third_rep", "inner").mapInPandas(_compared, "rep long").distinct()
    )


def _judged(spark: SparkSession, own: DataFrame) -> DataFrame:
    """(rep, is_copy, is_data, probability)."""
    label = (
        F.when(F.col("is_copy"), None).when((F.col("notice") == "generated") | (F.col("notice") == "banner") | F.col("is_data"), 1)
        .otherwise(0)
    )
    # the bounded sample comes to the driver, the least by hash; all rows are scored where they are
    sample = (
        own.withColumn("label", label).filter(F.col("label").isNotNull()).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE)
        .select("rep", "label", "features").toPandas().sort_values("rep")
    )
    y = sample["label"].to_numpy(dtype=float)
    if len(np.unique(y)) < 2:
        return own.select("rep", "is_copy", "is_data", F.lit(0.0).alias("probability"))
    x = np.stack(sample["features"].to_list()).astype(float)
    chosen = np.ones(len(y), dtype=bool)
    for _ in range(CLEANINGS):
        doubt = forest.fit(x[chosen], y[chosen], TREES, DEPTH, SEED).votes(x)
        chosen = (y == 1) | (doubt < DOUBT)
    shared = spark.sparkContext.broadcast(forest.fit(x[chosen], y[chosen], TREES, DEPTH, SEED))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                votes = shared.value.votes(np.stack(pdf["features"].to_list()).astype(float))
                yield pd.DataFrame({"rep": pdf["rep"], "is_copy": pdf["is_copy"], "is_data": pdf["is_data"], "probability": votes})

    return own.select("rep", "is_copy", "is_data", "features").mapInPandas(scored, "rep long, is_copy boolean, is_data boolean, probability double")
