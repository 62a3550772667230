"""Garbled text from wrong character encoding: found and restored with a table of garbled forms.

Every distinct word of the corpus with a non-ASCII character is garbled under all encoding chains; the words of
the documents are hash-joined with that table, and verified hits give the documents and the originals.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

#: Encodings that UTF-8 bytes are read as, those of repeated damage, and single-byte ones taken for each other.
UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "iso8859-2", "cp866", "iso8859-15"]
AGAIN = ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251"]
SINGLE = ["cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "mac_roman"]
LOST_FROM = ["cp1252", "cp1250", "cp1251"]

#: Evidence a document needs: one hit that is certain by itself, or two different weak ones of one chain, not
#: both single characters.
CERTAIN, WEAK = 2, 1
#: Different words of one document and chain that are certain together though their originals are not the more
#: frequent: each original reads like a word and the garbled form does not.
MANY = 3
#: Unit of the number of texts in the frequency of a word; the number of documents is below it.
TEXTS = 1 << 32

LOST = "�"


@lru_cache(maxsize=None)
def _tables(codec: str) -> tuple[dict[int, str], dict[int, int]]:
    """Byte to character and back; bytes the codec leaves undefined stand for the control of that number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return dict(enumerate(chars)), {ord(c): b for b, c in reversed(list(enumerate(chars)))}


def read_as(data: bytes, codec: str) -> str:
    return data.decode("latin-1").translate(_tables(codec)[0])


def written_as(text: str, codec: str) -> bytes | None:
    """The bytes of ``text`` in a single-byte codec, or None."""
    back = _tables(codec)[1]
    try:
        return bytes([back[ord(c)] for c in text])
    except KeyError:
        return None


@lru_cache(maxsize=1)
def chains() -> list[tuple[str, ...]]:
    """Encoding chains (written as, read as, written as, read as ...), the likelier first."""
    once = [("utf-8", t) for t in UTF8_READ_AS]
    twice = [("utf-8", a, "utf-8", b) for a, b in product(AGAIN, AGAIN)]
    thrice = [("utf-8", a) * 3 for a in AGAIN]
    return once + twice + thrice + list(permutations(SINGLE, 2))


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """``text`` after the chain, or None if it cannot go through it."""
    for write, read in zip(chain[::2], chain[1::2]):
        data = text.encode("utf-8", "surrogatepass") if write == "utf-8" else written_as(text, write)
        if data is None:
            return None
        text = read_as(data, read)
    return text


def ungarble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text that the chain turns into ``text``, or None if there is none."""
    for write, read in zip(chain[-2::-2], chain[::-2]):
        data = written_as(text, read)
        if data is None:
            return None
        try:
            text = data.decode("utf-8") if write == "utf-8" else read_as(data, write)
        except UnicodeDecodeError:
            return None
    return text


def _lost_forms(word: str) -> set[str]:
    """Forms in which undecodable bytes became replacement characters."""
    out = {"".join(LOST * len(c.encode()) if ord(c) > 127 else c for c in word), "".join(LOST if ord(c) > 127 else c for c in word)}
    for codec in LOST_FROM:
        data = written_as(word, codec)
        if data is not None:
            out.add(data.decode("utf-8", "replace"))
    return {x for x in out if LOST in x}


#: Bits of the table of words that the forms are sifted by, as a power of 2. A full table only lets more through.
SIFT = 25


def _places(words: Iterable[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - SIFT) for w in words), dtype=np.int64)


def _either(a: bytes, b: bytes) -> bytes:
    """Two packed tables of bits joined; an empty one has none set."""
    if not a or not b:
        return a or b
    x, y = (np.frombuffer(zlib.decompress(z), np.uint8) for z in (a, b))
    return zlib.compress((x | y).tobytes(), 1)


def seen_words(words: DataFrame) -> bytes:
    """Packed table of bits, one set for the place of each word; its size is bounded whatever the number of words."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << SIFT, dtype=bool)
        for pdf in batches:
            bits[_places(pdf["word"])] = True
        yield pd.DataFrame({"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    return words.select("word").mapInPandas(mark, "bits binary").rdd.map(lambda r: bytes(r[0])).treeAggregate(b"", _either, _either, 3)


def _forms(seen: Broadcast):
    """Garbled forms of each word under all chains, those left out that no document has a word for."""

    def formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [(k, c, ">".join(c)) for k, c in enumerate(chains())]
        bits = np.unpackbits(np.frombuffer(zlib.decompress(seen.value), np.uint8)) if seen.value else np.zeros(1 << SIFT, np.uint8)
        for pdf in batches:
            out = []
            for word, n in zip(pdf["word"], pdf["n"]):
                if LOST in word:
                    continue
                for k, chain, name in every:
                    g = garble(word, chain)
                    if g is not None and g != word:
                        out.append((g, word, n, name, k))
                out += [(g, word, n, "lost", len(every)) for g in _lost_forms(word)]
            frame = pd.DataFrame(out, columns=["garbled", "original", "n_original", "chain", "chain_no"])
            yield frame[bits[_places(frame["garbled"])] > 0] if len(frame) else frame

    return formed


#: A word of one alphabet, in lower case, capitalised or in capitals; a Latin one has a letter without accent. The
#: second form allows several with typographic signs around and between them.
_LATIN, _CYRILLIC = (rf"(?:[\p{{Is{s}}}&&\p{{Lu}}]?[\p{{Is{s}}}&&\p{{Ll}}]+|[\p{{Is{s}}}&&\p{{Lu}}]+)" for s in ("Latin", "Cyrillic"))
_PLAIN = rf"^(?:(?=.*[A-Za-z]){_LATIN}(?:['’-]{_LATIN})*|{_CYRILLIC}(?:['’-]{_CYRILLIC})*)$"
_SIGN = r"[\p{Punct}0-9‘’“”„«»‹›–—…•€£§©®™°±²³µ¶½×¿¡≠≤≥≈→∞√\u00A0\u202F]"
_READS = rf"^{_SIGN}*(?:(?:(?=\p{{L}}*[A-Za-z]){_LATIN}|{_CYRILLIC})(?:{_SIGN}+|$))*$"

_EDGE = r"!-/:-@\[-`{-~"
#: A word alone between quotes, backticks or brackets, as examples of damage are written.
_QUOTED = rf"^[{_EDGE}]*[`'\"(\[<{{][^\x00-\x7F]+[`'\")\]>}}][{_EDGE}]*$"


def _words(text: Column) -> Column:
    """Words (between ASCII blanks) with a non-ASCII character."""
    return F.filter(F.split(text, r"[\x00-\x20]+"), lambda w: w.rlike(r"[^\x00-\x7F]"))


def _core(word: Column) -> Column:
    """The word without ASCII punctuation at its ends and with each number as 0."""
    return F.regexp_replace(F.regexp_replace(word, rf"^[{_EDGE}]+|[{_EDGE}]+$", ""), "[0-9]+", "0")


def damaged_words(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word, original, chain, weight, alike, by): the words of each document that are garbled forms.

    ``word`` and ``original`` stand without edge punctuation and with numbers as 0. A hit under a UTF-8 chain is
    certain. Under a chain of single-byte encodings, where sound words can look like garbled ones, the original
    must be the more frequent among the different texts of the corpus and longer than two characters to be certain;
    otherwise it takes MANY such words of one chain in the document, whose originals read like words while they
    do not. A word with replacement
    characters within letters or digits, or repeatedly of them alone, is certain, its original known only if one
    clean word gives that form. UTF-8 damage of words whose sound form is nowhere in the corpus is found by
    reversing the chain. Words alone in quotes, backticks or brackets are examples of damage and no hits.
    ``chain`` and ``original`` are the likeliest; ``alike`` lists all chains that give the word;
    ``by`` is ``table``, or ``reversal`` for what only reversing the chain or a mark of loss tells. Null and empty
    texts have no rows.
    """
    scratch = Scratch(spark, "encodings")
    seen = scratch.keep(
        docs.filter(F.col(text).isNotNull())
        .select(F.col(doc_id), F.xxhash64(text).alias("text_key"), F.explode(_words(F.col(text))).alias("raw"))
        .select(doc_id, "text_key", _core(F.col("raw")).alias("word"), F.col("raw").rlike(_QUOTED).alias("quoted"))
        .filter(F.length("word") > 0)
        .groupBy(doc_id, "word").agg(F.bool_and("quoted").alias("quoted"), F.count(F.lit(1)).alias("times"), F.min("text_key").alias("text_key"))
    )
    # copies of a text count once; only between equal numbers of texts do documents count, in the low half of n
    words = scratch.keep(seen.groupBy("word", "text_key").agg(F.bool_and("quoted").alias("quoted"), F.count(F.lit(1)).alias("_docs")).groupBy("word").agg(
        (F.count(F.lit(1)) * TEXTS + F.sum("_docs")).alias("n"), F.bool_and("quoted").alias("always_quoted")))
    sift = spark.sparkContext.broadcast(seen_words(words))
    forms = words.filter("NOT always_quoted").select("word", "n").repartition(F.col("word")).mapInPandas(
        _forms(sift), "garbled string, original string, n_original long, chain string, chain_no long"
    )
    plain, odd = F.col("original").rlike(_PLAIN), ~F.col("garbled").rlike(_READS)
    in_texts = F.shiftright("n_original", 32) > F.shiftright("n", 32)
    frequent = F.col("chain").startswith("utf-8") | (F.col("chain") == "lost") | in_texts | ((F.col("n_original") > F.col("n")) & (plain | odd) & (F.shiftright("n_original", 32) == F.shiftright("n", 32)))
    every = scratch.keep(
        forms.join(words, F.col("garbled") == F.col("word"), "inner")
        .select("garbled", "original", "n_original", "chain", "chain_no", frequent.alias("frequent"), ((F.length("original") > 2) & plain & odd).alias("reads"))
    )
    hits = every.filter("frequent").drop("frequent", "reads")
    # an original that is itself damaged is only a step on the way
    steps = hits.filter(F.col("chain") != "lost").select(F.col("garbled").alias("_step")).distinct()
    ranked = hits.join(steps, F.col("original") == F.col("_step"), "left").select(
        "garbled", "original", "chain", F.col("_step").isNotNull().alias("_is_step"), "chain_no", "n_original"
    )
    likeliest = F.struct(
        "_is_step", F.col("chain").startswith("utf-8").cast("int") * -1, -F.col("n_original"), "chain_no", "original", "chain"
    )
    best = ranked.groupBy("garbled").agg(
        F.min(likeliest).alias("_b"),
        F.count_distinct(F.when(~F.col("_is_step"), F.col("original"))).alias("_n"),
        F.array_sort(F.collect_set("chain")).alias("alike"),  # at most the number of chains
    ).select("garbled", "_b.original", "_b.chain", "_n", "alike")
    known = best.select(
        "garbled", F.when((F.col("chain") != "lost") | (F.col("_n") == 1), F.col("original")).alias("original"), "chain", "alike"
    )
    rest = words.join(best, F.col("word") == F.col("garbled"), "left_anti").select("word").mapInPandas(
        _reversed, "garbled string, original string, chain string"
    )
    table = scratch.keep(known.withColumn("by", F.lit("table")).unionByName(rest.withColumn("alike", F.array("chain")).withColumn("by", F.lit("reversal"))))
    letters = F.length(F.regexp_replace("word", "[0-9]", ""))
    certain = (
        (F.col("chain").startswith("utf-8"))
        | ((F.col("chain") == "lost") & (F.col("word").rlike(rf"[\p{{L}}0-9]{LOST}|{LOST}[\p{{L}}0-9]") | (F.col("times") > 1)))
        | ((F.col("chain") != "lost") & (letters > 2))
    )
    weak = F.when(F.col("chain") == "lost", 0).otherwise(WEAK)
    sure = seen.filter("NOT quoted").join(table, F.col("word") == F.col("garbled"), "inner").select(
        doc_id, "word", "original", "chain", F.when(certain, CERTAIN).otherwise(weak).alias("weight"), "alike", "by"
    )
    rare = every.filter("NOT frequent").join(table.select("garbled"), "garbled", "left_anti").select("garbled", "chain", "chain_no", "original", "reads")
    fits = scratch.keep(seen.filter("NOT quoted").join(rare, F.col("word") == F.col("garbled"), "inner").select(doc_id, "word", "original", "chain", "chain_no", "reads"))
    together = fits.filter("reads").groupBy(doc_id, "chain").agg(F.count_distinct("word").alias("_n")).filter(F.col("_n") >= MANY).select(doc_id, "chain")
    many = fits.join(together, [doc_id, "chain"], "left_semi").groupBy(doc_id, "word").agg(
        F.min(F.struct("chain_no", "original", "chain")).alias("_b"), F.array_sort(F.collect_set("chain")).alias("alike")
    ).select(doc_id, "word", "_b.original", "_b.chain", F.lit(CERTAIN).alias("weight"), "alike", F.lit("table").alias("by"))
    return sure.unionByName(many)


_SOUND = re.compile(r"[A-Za-zÀ-ÖØ-öø-žșțА-яЁёІіЇїЄєҐґ‘’“”„«»–—…•€£§©®™°±²³µ¶½×ß¿¡≠≤≥≈→∞√  '.,;:!?()0-9/_-]+")


def _reversed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words without a clean counterpart that a UTF-8 chain turns into plausible text, or with lost characters."""
    once = [(c, ">".join(c)) for c in chains() if c[0] == "utf-8"]
    for pdf in batches:
        out = []
        for word in pdf["word"]:
            if LOST in word:
                out.append((word, None, "lost"))
                continue
            for chain, name in once:
                back = ungarble(word, chain)
                wide = 0 if back is None else sum(ord(c) > 127 for c in back)
                # Cyrillic letters followed by punctuation can be sound; two sequences in a word cannot
                if wide and _SOUND.fullmatch(back) and (wide > 1 or chain[1] not in ("cp1251", "koi8-r", "cp866")):
                    out.append((word, back, name))
                    break
        yield pd.DataFrame(out, columns=["garbled", "original", "chain"])


def damaged_documents(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words) of the documents with enough evidence in ``damaged_words``."""
    per_chain = hits.select(doc_id, "weight", F.length("word").alias("_len"), F.explode("alike").alias("_chain")).groupBy(
        doc_id, "_chain"
    ).agg(F.max("weight").alias("_top"), F.sum("weight").alias("_sum"), F.max("_len").alias("_len"), F.count(F.lit(1)).alias("_n"))
    enough = (F.col("_top") >= CERTAIN) | ((F.col("_sum") >= CERTAIN) & (F.col("_len") > 1))
    return per_chain.filter(enough).groupBy(doc_id).agg(F.max("_n").alias("n_words"))


def evidence(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_table, n_reversal) of the damaged documents: how many of their words the table of garbled forms
    tells, and how many only the reversal."""
    found = damaged_documents(hits, doc_id).select(doc_id)
    return hits.join(found, doc_id, "left_semi").groupBy(doc_id).agg(
        F.count_if(F.col("by") == "table").alias("n_table"), F.count_if(F.col("by") == "reversal").alias("n_reversal")
    )


def restored(docs: DataFrame, hits: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_restored, n_lost) of the damaged documents, each damaged word replaced by its original.

    A word is restored by reversing its chain, so numbers and punctuation in it stay; one with replacement
    characters by the only clean word that gives its form, if there is no number in it. Others count as lost.
    """
    found = damaged_documents(hits, doc_id)
    per_doc = (
        hits.filter("weight > 0").join(found.select(doc_id), doc_id, "left_semi")
        .groupBy(doc_id).agg(F.collect_list(F.struct("word", "original", "chain")).alias("_hits"))
    )
    kind = docs.schema[doc_id].dataType.simpleString()

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t, hs in zip(pdf[doc_id], pdf[text], pdf["_hits"]):
                out.append((d, *_mended(t, {h["word"]: (h["original"], h["chain"]) for h in hs})))
            yield pd.DataFrame(out, columns=[doc_id, text, "n_restored", "n_lost"])

    return docs.select(doc_id, text).join(per_doc, doc_id, "inner").mapInPandas(
        mend, f"{doc_id} {kind}, {text} string, n_restored long, n_lost long"
    )


_EDGES = re.compile(rf"^[{_EDGE}]+|[{_EDGE}]+$")
_NUMBER = re.compile("[0-9]+")


def _mended(text: str, table: dict[str, tuple[str | None, str]]) -> tuple[str, int, int]:
    done = lost = 0

    def one(m: re.Match) -> str:
        nonlocal done, lost
        raw = m.group()
        if raw.isascii():
            return raw
        core = _EDGES.sub("", raw)
        hit = table.get(_NUMBER.sub("0", core))
        if hit is None:
            return raw
        original, chain = hit
        if chain == "lost":
            new = raw.replace(core, original) if original and not _NUMBER.search(core) else None
        else:
            new = ungarble(raw, tuple(chain.split(">")))
        if new is None:
            lost += 1
            return raw
        done += 1
        return new

    return re.sub(r"[^\x00-\x20]+", one, text), done, lost
