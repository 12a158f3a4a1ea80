"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

1. A task gives, for each prefix it finds, one stripe: the next words and how often each follows. What
   need not be told apart (the end of a piece, a next word that is rare) is counted under no word, so
   that the sum of a stripe is how often its prefix occurs.
2. Stripes of a prefix are merged elementwise. A task sends them in bundles, one for each bucket of a hash of
   language and prefix, so that its rows are bounded by the buckets and not by the prefixes that are frequent;
   a bucket is added up as a whole. The stripe of no words at all, which holds the vocabulary, and those of very
   frequent prefixes are cut into segments by a hash of the next word, so no bucket holds one whole.
3. A merged stripe tells the extensions that are frequent, the total of its prefix, and the most frequent
   extension, which decides on subsumption. A phrase is frequent only if its parts are, so the stripes of
   longer prefixes are asked for frequent parts only: first the vocabulary, then pairs, then triples, then the
   rest in one pass. Tasks know frequent parts by bit tables of a fixed size, which let some rare parts through
   and no frequent one out: what they let through is counted and then dropped.

Counts are exact and over all texts. Phrases are told apart by their words, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotflow.llm.text import LOWER, MIX, encode, gather, hash_all, mix, slices, text_bytes, word_bounds
from depotflow.session import durable

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
SUBSUMED = 100  # per cent of a phrase's occurrences that lie in a longer one
TOP = 2000  # phrases reported of each language
NO_LANGUAGE = "und"
BITS = 25  # places of the tables of frequent parts
HOT = 1 << 20  # occurrences of a prefix from which on its stripe is cut into segments
SEGMENTS = 256
SLICE = 1 << 24  # bytes of text that a task counts at once
BUCKETS = 1 << 12  # of prefixes, at least
WORDS = 1 << 19  # of the texts for a bucket; beyond that there are more buckets

# A word ends at a space, a tab, or a mark that ends the piece.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
IN_WORD = ~BREAK
IN_WORD[[0x20, 0x09]] = False

KEYS = ("lang", "prefix", "segment")
STRIPE = "lang string, prefix string, segment int, words array<string>, counts array<long>"
#: The stripes of a bucket, one after the other; ``sizes`` are their entries.
BUNDLE = ("bucket int, lang array<string>, prefix array<string>, segment array<int>, sizes array<int>, "
          "words array<string>, counts array<long>")


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word; that of no words is the language's."""
    return mix((before ^ (before >> np.uint64(29))) * MIX + word)


class Parts:
    """Bit tables, of a fixed size, of phrases that are frequent and of those that are very frequent."""

    def __init__(self, frequent: np.ndarray, hot: np.ndarray):
        self.tables = frequent, hot

    def _has(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        return (table[place >> 6] >> (place & 63)) & 1 == 1

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(self.tables[0], hashes)

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(self.tables[1], hashes)


class Corpus:
    """The words of a slice of texts: their codes, and what of them stands in one piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets = text_bytes(text)
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, offsets, IN_WORD)
        self.codes, self.words = encode(data, starts, ends)
        coded = pc.fill_null(lang, NO_LANGUAGE).dictionary_encode()
        self.langs = coded.dictionary
        doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        self.lang = coded.indices.to_numpy()[doc].astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(BREAK[data]), starts)
        #: whether a word and the next one stand in the same piece
        self.goes_on = np.zeros(len(starts), bool)
        if len(starts):
            self.goes_on[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        self.lang_hash = hash_all(self.langs.cast(pa.binary()))
        self.word_hash = hash_all(self.words)

    def hashes(self, length: int) -> np.ndarray:
        """The hash of the phrase of ``length`` words from each word on, its language's among them."""
        out = self.lang_hash[self.lang] if len(self.lang) else np.zeros(0, np.uint64)
        for k in range(length):
            out = _joined(out[:len(self.codes) - k], self.word_hash[self.codes[k:]])
        return out


def _stripes(corpus: Corpus, at: np.ndarray, prefix: np.ndarray, length: int, following: np.ndarray,
             hot: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A stripe per prefix and segment, in bundles: ``at`` has the first words of the prefixes, ``prefix`` the number
    that tells them apart, ``following`` the code of the next word or -1."""
    words = len(corpus.words)
    keys, counts = np.unique(prefix * (words + 1) + following + 1, return_counts=True)
    prefix_of, word = keys // (words + 1), keys % (words + 1) - 1
    numbers, one = np.unique(prefix, return_index=True)
    at, hot = at[one], hot[one]
    which = np.searchsorted(numbers, prefix_of)
    segment = np.where(hot[which] & (word >= 0), (corpus.word_hash[word] % np.uint64(SEGMENTS)).astype(np.int64)
                       if words else 0, 0)
    order = np.lexsort((segment, which))
    which, segment, word, counts = which[order], segment[order], word[order], counts[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    at, segment, sizes = at[which[first]], segment[first], np.diff(np.append(first, len(which)))
    hashes = corpus.lang_hash[corpus.lang[at]]
    for k in range(length):
        hashes = _joined(hashes, corpus.word_hash[corpus.codes[at + k]])
    bucket = (mix(hashes + segment.astype(np.uint64) * MIX) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    entries = gather(first[order], sizes[order])
    at, segment, sizes, bucket, word, counts = (
        at[order], segment[order], sizes[order], bucket[order], word[entries], counts[entries])
    rows = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    stripe_ends = np.append(rows, len(at))
    bounds = pa.array(stripe_ends.astype(np.int32))
    entry_bounds = pa.array(np.concatenate(([0], np.cumsum(sizes)))[stripe_ends].astype(np.int32))
    none = pa.array(word < 0)
    text = corpus.words.cast(pa.string())
    named = text.take(pa.array(np.maximum(word, 0), mask=word < 0)) if words else pa.nulls(len(none), pa.string())
    spoken = [text.take(pa.array(corpus.codes[at + k])) for k in range(length)]
    told = pc.binary_join_element_wise(*spoken, " ") if spoken else pa.array([""] * len(at), pa.string())
    langs = corpus.langs.take(pa.array(corpus.lang[at])).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[rows]), *(pa.ListArray.from_arrays(bounds, column) for column in (
            langs, told, pa.array(segment.astype(np.int32)), pa.array(sizes.astype(np.int32)))),
         pa.ListArray.from_arrays(entry_bounds, named),
         pa.ListArray.from_arrays(entry_bounds, pa.array(counts.astype(np.int64)))],
        names=["bucket", *KEYS, "sizes", "words", "counts"])


def vocabulary(corpus: Corpus, buckets: int = BUCKETS) -> Iterator[pa.RecordBatch]:
    """Stripes of no words: every word of a language."""
    if len(corpus.codes):
        yield _stripes(corpus, np.arange(len(corpus.codes)), corpus.lang, 0, corpus.codes.astype(np.int64),
                       np.ones(len(corpus.codes), bool), buckets)


def extensions(corpus: Corpus, parts: Parts, lengths: range, buckets: int = BUCKETS) -> Iterator[pa.RecordBatch]:
    """Stripes of the prefixes of these lengths. ``parts`` knows the frequent phrases as long as the least."""
    least = lengths[0]
    total = len(corpus.codes)
    if not total:
        return
    hashes = corpus.hashes(least)
    frequent = np.zeros(total, bool)
    if len(hashes):
        frequent[:len(hashes)] = parts.frequent(hashes)
    run = np.ones(total, bool)  # whether the phrase stays in its piece
    for k in range(least - 1):
        run[:total - k] &= corpus.goes_on[k:]
        run[max(total - k, 0):] = False
    frequent &= run
    at = np.flatnonzero(frequent)
    number = np.zeros(total, np.int64)
    words = len(corpus.words)
    if len(at):
        number[at] = corpus.lang[at]
        for k in range(least):
            number[at] = np.unique(number[at] * words + corpus.codes[at + k], return_inverse=True)[1]
    for length in lengths:
        if not len(at):
            return
        # The next word is told apart if the phrase that ends with it may be frequent.
        end = at + length - least + 1
        inside = np.minimum(end, total - 1)
        further = (end < total) & frequent[inside] & corpus.goes_on[at + length - 1]
        following = np.where(further, corpus.codes[np.minimum(at + length, total - 1)], -1).astype(np.int64)
        hot = parts.hot(hashes[at]) if length == least else np.zeros(len(at), bool)
        yield _stripes(corpus, at, number[at], length, following, hot, buckets)
        at, following = at[further], following[further]
        number[at] = np.unique(number[at] * words + following, return_inverse=True)[1]


def stripes(docs: DataFrame, parts: Parts | None, lengths: range, buckets: int = BUCKETS) -> DataFrame:
    """Stripes of the prefixes of these lengths as tasks find them in (text, lang), in bundles."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def work(batches):
        parts = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                corpus = Corpus(part["text"], part["lang"])
                yield from (vocabulary(corpus, buckets) if parts is None
                            else extensions(corpus, parts, lengths, buckets))

    return docs.mapInArrow(work, BUNDLE)


def _added(table: pa.Table, least: int) -> pa.Table:
    """The stripes of a bucket, those of a key added up: the sum of each, and its entries from ``least`` on."""
    flat = {name: table[name].combine_chunks().flatten() for name in table.column_names if name != "bucket"}
    lang, prefix = flat["lang"].dictionary_encode(), flat["prefix"].dictionary_encode()
    key = prefix.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()
    _, first, stripe = np.unique(key * SEGMENTS + flat["segment"].to_numpy(), return_index=True, return_inverse=True)
    coded = flat["words"].dictionary_encode()
    size = len(coded.dictionary) + 1
    word = pc.fill_null(coded.indices, size - 1).to_numpy().astype(np.int64)
    owner = np.repeat(stripe, flat["sizes"].to_numpy())
    entry, inverse = np.unique(owner * size + word, return_inverse=True)
    sums = np.zeros(len(entry), np.int64)
    np.add.at(sums, inverse, flat["counts"].to_numpy())
    owner, word = entry // size, entry % size
    total = np.zeros(len(first), np.int64)
    np.add.at(total, owner, sums)
    told = (word < size - 1) & (sums >= least)
    owner, word, sums = owner[told], word[told], sums[told]
    bounds = pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32))
    return pa.table([*(flat[name].take(pa.array(first)) for name in KEYS),
                     pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(word))),
                     pa.ListArray.from_arrays(bounds, pa.array(sums)), pa.array(total)],
                    names=[*KEYS, "words", "counts", "total"])


def merged(found: DataFrame, least: int) -> DataFrame:
    """Stripes of a prefix and segment, single or in bundles, added up elementwise: their sum, and what is frequent of
    them."""
    if "bucket" not in found.columns:
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int").alias("bucket")
        found = found.select(bucket, *(F.array(name).alias(name) for name in KEYS),
                             F.array(F.size("words")).alias("sizes"), "words", "counts")
    return found.groupBy("bucket").applyInArrow(lambda table: _added(table, least), STRIPE + ", total long")


def extended(stripe: DataFrame) -> DataFrame:
    """Frequent phrases, one row for each frequent entry of a merged stripe."""
    return (stripe.where(F.size("words") > 0)
            .select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("entry"))
            .select("lang", F.when(F.col("prefix") == "", F.col("entry.words"))
                    .otherwise(F.concat_ws(" ", "prefix", "entry.words")).alias("phrase"),
                    "prefix", F.col("entry.counts").alias("f")))


def known(phrases: DataFrame) -> Parts:
    """The bit tables of frequent and of very frequent phrases: at most 2^19 words of 64 bits each."""

    def work(batches):
        for batch in batches:
            out = hash_all(batch["lang"].cast(pa.binary()))
            split = [p.split(b" ") for p in batch["phrase"].cast(pa.binary()).to_pylist()]
            for k in range(len(split[0]) if split else 0):
                out = _joined(out, hash_all(pa.array([s[k] for s in split], pa.binary())))
            place = (out >> np.uint64(64 - BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch["f"]], names=["place", "f"])

    places = phrases.select("lang", "phrase", "f").mapInArrow(work, "place long, f long")
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    words = (places.groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.bit_or(bit).alias("frequent"),
                  F.coalesce(F.bit_or(F.when(F.col("f") >= HOT, bit)), F.lit(0)).alias("hot")).toPandas())
    tables = np.zeros((2, 1 << (BITS - 6)), np.int64)
    for table, name in zip(tables, ("frequent", "hot"), strict=True):
        table[words["word"].to_numpy(np.int64)] = words[name].to_numpy(np.int64)
    return Parts(*tables)


def _rows(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_column: str = "text",
            lang_column: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The merged stripes of all frequent prefixes (``lang``, ``prefix``, ``segment``, ``words``, ``counts``,
    ``total``), and of no words (prefix ''), whose totals add up to the words of a language."""
    docs = _rows(docs, text_column, lang_column)
    first = durable(merged(stripes(docs, None, range(0, 1)), least))
    buckets = max(BUCKETS, (first.agg(F.sum("total")).first()[0] or 0) // WORDS)
    found = latest = durable(merged(stripes(docs, known(extended(first)), range(1, 2), buckets), least))
    for lengths in (range(2, min(3, longest)), range(3, longest)):
        if lengths:
            latest = durable(merged(stripes(docs, known(extended(latest)), lengths, buckets), least))
            found = found.unionByName(latest)
    return first, found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED,
                 text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur at least ``least`` times in a language, each with its
    lowest-scoring cut (``k`` words and the rest), less those that mostly lie in a longer one.

    Columns: ``lang``, ``phrase``, ``a`` (its occurrences), ``k``, ``l`` and ``r`` (those of the two parts), ``n`` (words of
    the language), ``score`` floor(1000 a n / (l r)). A null language counts as ``und``, a null text as
    empty; every row counts, repeated ones too. Further columns are left out; without texts there are no rows.
    """
    vocabulary, longer = counted(docs, least, longest, text_column, lang_column)
    sizes = vocabulary.groupBy("lang").agg(F.sum("total").alias("n"))
    phrases = durable(extended(longer))
    # What a cut can need: the totals of prefixes, and phrases at the end of others, which are entries.
    parts = durable(extended(vocabulary).select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f")))
    totals = longer.groupBy("lang", F.col("prefix").alias("left")).agg(F.sum("total").alias("l"))
    words = F.split("phrase", " ")
    cuts = (phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
            .select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("left"),
                    F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("right")))
    score = F.expr("(CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(18,0)) * 1000BD) "
                   "div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = (cuts.join(totals, ["lang", "left"])
              .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
              .join(sizes, "lang").withColumn("score", score))
    best = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.k", "cut.l", "cut.r", "n", "cut.score"))
    # A longer phrase holds one with a single word more that is at least as frequent, so these suffice.
    held = (phrases.where(F.size(words) > 2)
            .select("lang", "f", F.explode(F.array(F.col("prefix"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")))
                    .alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("f").alias("most")))
    return (best.join(held, ["lang", "phrase"], "left")
            .where(F.col("most").isNull() | (100 * F.col("most") < subsumed * F.col("a"))).drop("most"))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first of each language: score and occurrences falling, then phrase by its bytes."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
