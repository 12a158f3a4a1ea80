"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of 13 consecutive words (an item with fewer words is one window).
A window is the set of its word shingles; a document contains the window only if it contains
all of them, so one shingle is a necessary prefix: the rarest, by the number of documents that
hold it. The steps:

1. Windows and their shingles; equal windows of several items are kept once.
2. Document frequencies of the windows' shingles over all documents. A bit table of fixed
   size tells tasks which shingles matter; it is no filter of results, only of work.
3. Shingles ordered by rarity; each window keeps its rarest one and the place it has there. A window
   with a shingle that no document holds is dropped.
4. Documents are joined on the prefix shingles. The place in the window gives the only start
   the window can have in the document; start and end must lie within the document (the
   positional and length bounds), and the words there must equal the window's words.
5. Per document: words under any window that occurs, and items with windows that occur.

Cases: a null or empty text has no words and no hits; an item without id or words is left out; equal
rows are kept, each with its result; an empty table of either kind gives no hits. Further
columns of either table are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotflow.llm.text import (ALPHANUMERIC, LOWER, encode, hash_all, shingles, slices, text_bytes,
                                within, word_bounds)
from depotflow.session import durable

WINDOW = 13
SHINGLE = 4
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Bits of the table that tells whether a shingle may matter: 4 MB at most, whatever the benchmark.
BITS = 25


def _split(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, ALPHANUMERIC)
    codes, distinct = encode(data, starts, ends)
    hashes = hash_all(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    return data, starts, ends, rows, hashes


def item_windows(items: DataFrame, window: int = WINDOW, size: int = SHINGLE,
                 id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """A row per window of an item: its words, their number, and its shingles with their places."""
    rows = items.select(F.col(id_column).cast("string").alias("item_id"),
                        F.col(text_column).alias("text")).where(F.col("item_id").isNotNull())

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                data, starts, ends, rows, hashes = _split(part["text"])
                out = []
                for i, item in enumerate(part["item_id"].to_pylist()):
                    first, last = int(rows[i]), int(rows[i + 1])
                    n = min(window, last - first)
                    if not n:
                        continue
                    k = min(size, n)
                    marks = shingles(hashes[first:last], k).view(np.int64)
                    words = [data[a:b].tobytes().decode()
                             for a, b in zip(starts[first:last], ends[first:last], strict=True)]
                    for at in range(len(words) - n + 1):
                        out.append((item, " ".join(words[at:at + n]), n, k,
                                    marks[at:at + n - k + 1].tolist()))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()),
                         pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.list_(pa.int64()))],
                        names=["item_id", "words", "n", "k", "shingles"])

    return rows.mapInArrow(cut, "item_id string, words string, n int, k int, shingles array<long>")


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """One bit for each key's place; 2**BITS bits, so what reaches the driver is bounded."""
    place = F.shiftrightunsigned(column, 64 - BITS)
    found = (keys.select(place.alias("place")).distinct()
             .groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits"))
             .toPandas())
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def marked(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return table[(marks >> np.uint64(64 - BITS)).astype(np.int64)]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE,
                  share: int = SHARE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``key`` (md5 of the text), ``n_words``, ``n_hit``,
    ``n_items``, ``items_sha256`` and ``contaminated``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("key", F.md5("text"))
    windows = durable(item_windows(items, window, size))
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # at most ``size`` numbers

    frequency = document_frequency(docs, windows, sizes)
    necessary = durable(
        windows.select("words", "n", "k", "shingles").dropDuplicates(["words"])
        .select("words", "n", "k", F.posexplode("shingles").alias("at", "shingle"))
        .join(frequency, "shingle", "left")
        .groupBy("words").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "shingle", "at",
                                             "n", "k")).alias("rarest"))
        .where("rarest.docs > 0")
        .select("words", "rarest.shingle", "rarest.at", "rarest.n", "rarest.k"))
    wanted = spark.sparkContext.broadcast(bit_table(necessary, "shingle"))
    found = durable(docs.mapInArrow(
        _candidates(wanted, sizes, window),
        f"doc_id {doc_id}, key string, n_words long, at long, shingle long, before int, "
        "around string"))

    words_there = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("window_at") + 1,
                                       F.col("n")), " ")
    matched = (
        found.where(F.col("shingle").isNotNull())
        .join(necessary.select("words", "n", F.col("at").alias("window_at"), "shingle"), "shingle")
        .withColumn("start", F.col("at") - F.col("window_at"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
               & (F.col("before") >= F.col("window_at")) & (words_there == F.col("words")))
        .select("doc_id", "key", "start", (F.col("start") + F.col("n")).alias("end"), "words")
        .distinct())
    matched = durable(matched)
    in_order = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    hits = (matched.groupBy("doc_id", "key", "start").agg(F.max("end").alias("end"))
            .withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0))))
            .select("doc_id", "key", F.greatest(F.col("end") - F.col("from"), F.lit(0)).alias("hit")))
    of_items = (matched.select("doc_id", "key", "words").distinct()
                .join(windows.select("words", "item_id").distinct(), "words")
                .select("doc_id", "key", "item_id").distinct())
    none = F.lit(None)
    merged = (
        found.where(F.col("shingle").isNull())
        .select("doc_id", "key", "n_words", F.lit(1).alias("copy"), none.cast("long").alias("hit"),
                none.cast("string").alias("item_id"))
        .unionByName(hits.select("doc_id", "key", none.cast("long").alias("n_words"),
                                 none.cast("int").alias("copy"), "hit",
                                 none.cast("string").alias("item_id")))
        .unionByName(of_items.select("doc_id", "key", none.cast("long").alias("n_words"),
                                     none.cast("int").alias("copy"), none.cast("long").alias("hit"),
                                     "item_id"))
        .groupBy("doc_id", "key")
        .agg(F.max("n_words").alias("n_words"), F.sum("copy").alias("copies"),
             F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"),
             F.sort_array(F.collect_list("item_id")).alias("items")))
    return (merged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
                    .alias("contaminated")))


def document_frequency(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Number of documents that hold each shingle of a window (and of some other shingles)."""
    table = docs.sparkSession.sparkContext.broadcast(
        bit_table(windows.select(F.explode("shingles").alias("shingle")), "shingle"))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, _, rows, hashes = _split(part["text"])
                owner = np.repeat(np.arange(part.num_rows), np.diff(rows))
                for k in sizes:
                    marks = shingles(hashes, k)
                    at = np.flatnonzero(marked(table.value, marks) & within(rows, k, len(hashes)))
                    own, marks = owner[at], marks[at]
                    order = np.lexsort((own, marks))
                    own, marks = own[order], marks[order]
                    first = np.r_[True, (marks[1:] != marks[:-1]) | (own[1:] != own[:-1])][:len(marks)]
                    values, counts = np.unique(marks[first], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                        names=["shingle", "docs"])

    return (docs.select("text").mapInArrow(count, "shingle long, docs long")
            .groupBy("shingle").agg(F.sum("docs").alias("docs")))


def _candidates(wanted, sizes: list[int], window: int):
    """Of each document a row with its number of words, and a row for each prefix shingle in it."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, rows, hashes = _split(part["text"])
                n_words = np.diff(rows)
                owner = np.repeat(np.arange(part.num_rows), n_words)
                docs, places = [np.arange(part.num_rows)], [np.full(part.num_rows, -1, np.int64)]
                marks_of = [np.zeros(part.num_rows, np.int64)]
                for k in sizes:
                    marks = shingles(hashes, k)
                    at = np.flatnonzero(marked(wanted.value, marks) & within(rows, k, len(hashes)))
                    docs.append(owner[at]), places.append(at), marks_of.append(marks[at].view(np.int64))
                doc, place = np.concatenate(docs), np.concatenate(places)
                marks, plain = np.concatenate(marks_of), place < 0
                first = np.maximum(place - window, rows[doc])
                last = np.minimum(place + window, rows[doc + 1])
                around = [None if p else b" ".join([data[a:b].tobytes() for a, b in zip(
                    starts[f:t].tolist(), ends[f:t].tolist(), strict=True)]).decode()
                    for p, f, t in zip(plain.tolist(), first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(doc)), part["key"].take(pa.array(doc)),
                     pa.array(n_words[doc].astype(np.int64)),
                     pa.array(place - rows[doc], mask=plain), pa.array(marks, mask=plain),
                     pa.array((place - first).astype(np.int32), mask=plain),
                     pa.array(around, pa.string())],
                    names=["doc_id", "key", "n_words", "at", "shingle", "before", "around"])

    return work


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    bad = (contamination(docs, items, id_column=id_column, text_column=text_column)
           .where("contaminated").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    return docs.join(bad, docs[id_column].eqNullSafe(F.col("__id"))
                     & F.md5(docs[text_column]).eqNullSafe(F.col("__key")), "left_anti")
