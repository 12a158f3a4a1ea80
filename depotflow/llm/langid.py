"""Language identification by words first, then by progressively shorter character n-grams.

Training counts words and character n-grams (lengths 1 to ``LONGEST``) per language on a bounded
sample of labelled rows. A word of a text that training knows is scored by its log
frequency in each language. An unseen word is scored by its known n-grams of the greatest length
of which it has any. A text gets the language with the greatest sum; the score is the
share of that language when the mean evidence of a word is counted for at most
``EVIDENCE`` words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotflow.llm.text import LOWER, encode, hash_all, slices, text_bytes, word_bounds

#: Rows that training reads at most, about; rows are taken by a hash of id and text.
SAMPLE_ROWS = 8000
#: Words and n-grams seen less often in the sample are left out of the model.
LEAST = 2
LONGEST = 5
EVIDENCE = 20
UNKNOWN = "und"

# Letters only: ASCII letters and every byte of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True


def letter_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes, distinct lower-case words, first words of rows, and which rows hold a letter."""
    values = column.to_pylist()
    plain = [v is None or v.isascii() for v in values]
    if not all(plain):
        column = pa.array([v if a else v.lower() for v, a in zip(values, plain, strict=True)],
                          pa.large_string())
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, LETTERS)
    codes, distinct = encode(data, starts, ends)
    has = np.fromiter((any(c.isalpha() for c in v) if v and not (a and rows[i] < rows[i + 1]) else bool(v)
                       for i, (v, a) in enumerate(zip(values, plain, strict=True))), bool, len(values))
    return codes, distinct, rows, has


def gram_hashes(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``size`` characters of the words, edges marked, and their word."""
    marked = [f" {w.decode(errors='replace')} " for w in words]
    lengths = np.array([len(m) for m in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, size, np.uint64)
    for k in range(size):  # 21 bits hold a code point; longer n-grams are folded
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + points[k:k + n]
    inside = owner[:n] == owner[size - 1:]
    return out[inside], owner[:n][inside]


@dataclass
class LanguageModel:
    """Log frequencies per language: of words, and of n-grams by length."""

    languages: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]

    def score_words(self, values: list[bytes], hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), len(self.languages)), np.float32)
        known, at = _find(self.words[0], hashes)
        out[known] = self.words[1][at[known]]
        left = np.flatnonzero(~known)
        for size in range(LONGEST, 0, -1):
            if not len(left) or size not in self.grams:
                continue
            table, logs = self.grams[size]
            grams, owner = gram_hashes([values[i] for i in left], size)
            seen, at = _find(table, grams)
            counts = np.bincount(owner[seen], minlength=len(left))
            hit = counts > 0
            for k in range(len(self.languages)):
                sums = np.bincount(owner[seen], logs[at[seen], k], minlength=len(left))
                out[left[hit], k] = sums[hit] / counts[hit]
            left = left[~hit]
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang",
          id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on about ``sample_rows`` labelled rows, the same ones whenever the table is the same.

    Rows with a null text or label teach nothing. The counting is done in tasks; the counts that
    reach the driver are bounded by the sample.
    """
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                           F.col(lang_column).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull())
    total = rows.count()
    if not total:
        return LanguageModel([], (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)), {})
    if total > sample_rows:
        share = int(sample_rows / total * 2**32)
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**32)) < share)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part["lang"].to_pylist(), object)
                codes, distinct, offsets, _ = letter_words(part["text"])
                owner = np.repeat(np.arange(len(langs)), np.diff(offsets))
                values, hashes = distinct.to_pylist(), hash_all(distinct)
                for lang in sorted(set(langs.tolist())):
                    times = np.bincount(codes[(langs == lang)[owner]], minlength=len(values))
                    own = np.flatnonzero(times)
                    yield _counts(lang, 0, hashes[own], times[own])
                    for size in range(1, LONGEST + 1):
                        grams, of = gram_hashes([values[i] for i in own], size)
                        distinct_grams, inverse = np.unique(grams, return_inverse=True)
                        sums = np.bincount(inverse, times[own][of], minlength=len(distinct_grams))
                        yield _counts(lang, size, distinct_grams, sums)

    counted = (rows.mapInArrow(count, "lang string, size int, gram long, n long")
               .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
               .where(F.col("n") >= LEAST).toPandas())
    languages = sorted(counted["lang"].unique())
    tables = {}
    for size in range(LONGEST + 1):
        own = counted[counted["size"] == size]
        grams = own["gram"].to_numpy().astype(np.int64).view(np.uint64)
        table, inverse = np.unique(grams, return_inverse=True)
        counts = np.zeros((len(table), len(languages)))
        counts[inverse, own["lang"].map(languages.index).to_numpy(np.int64)] = own["n"].to_numpy()
        totals = counts.sum(axis=0) + 0.5 * len(table)
        tables[size] = (table, np.log((counts + 0.5) / totals).astype(np.float32))
    return LanguageModel(languages, tables[0], {k: tables[k] for k in range(1, LONGEST + 1)})


def _counts(lang: str, size: int, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), size, np.int32)),
         pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
        names=["lang", "size", "gram", "n"])


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text",
            keep: list[str | Column] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to the ``keep`` columns (all, by default).

    A text that is null, empty or holds no letter is ``und`` with score 0, and so is every text
    if training saw no language. Ties go to the first language by name. Columns of the input
    named like the new ones are replaced. One row per input row; rows may repeat.
    """
    kept = docs.select(*(keep if keep is not None else docs.columns))
    kept = kept.drop("lang_pred", "score")
    names = kept.columns
    rows = kept.withColumn("__text", docs[text_column]) if keep is None else \
        docs.select(*[c for c in keep if c not in ("lang_pred", "score")],
                    docs[text_column].alias("__text"))
    schema = kept.schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                lang, score = classify(model, part["__text"])
                yield pa.RecordBatch.from_arrays(
                    [part[n] for n in names] + [pa.array(lang), pa.array(score)],
                    names=names + ["lang_pred", "score"])

    return rows.mapInArrow(work, schema)


def classify(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    n = len(column)
    codes, distinct, rows, has = letter_words(column)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    scores = model.score_words(distinct.to_pylist(), hash_all(distinct))
    counts = np.diff(rows)
    owner = np.repeat(np.arange(n), counts)
    sums = np.stack([np.bincount(owner, scores[codes, k], minlength=n)
                     for k in range(len(model.languages))], axis=1)
    sums *= (np.minimum(counts, EVIDENCE) / np.maximum(counts, 1))[:, None]
    sums -= sums.max(axis=1, keepdims=True)
    share = np.exp(sums)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    lang = [model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
    return lang, np.where(has, share[np.arange(n), best], 0.0)
