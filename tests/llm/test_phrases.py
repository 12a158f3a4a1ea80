"""Phrase collocations against brute force."""

import collections
import random
import re

import pyarrow as pa
import pytest

from depotflow.llm import phrases, queries
from tests.compare import difference, duck, spark_rows, sql_rows
from tests.conftest import SF

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
KIND = "doc_id long, text string, lang string, prefix string, words int, total double"


def counts_of(rows):
    found = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in PIECE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = WORD.findall(piece)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    found["und" if lang is None else lang][tuple(w[i:i + size])] += 1
    return found


def brute(rows, least, subsumed=100):
    out = {}
    for lang, f in counts_of(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        held = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        for p, a in held.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [q for q in held if len(q) > len(p)
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * f[q] >= subsumed * a for q in longer):
                out[lang, " ".join(p)] = (a, k, f[p[:k]], f[p[k:]], n, score)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "cé", "日本", "D", "e", "the", "of", "x'y", "q-r"]
    fixed = ["new york city hall", "in the of the", "a b a b a b", "cé 日本"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        text = ""
        for p in parts:
            text += p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";x ", "\x0b"])
        out.append((text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return out


@pytest.mark.parametrize("least,subsumed,hot", [(4, 100, 1 << 20), (7, 60, 20)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, subsumed, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    rows = corpus(1, 120) + [(None, "en"), ("", None), (" \t.\n", "fr"), ("lonely", "xx"), ("a b " * 4000, "en")]
    rows += rows[:5]  # repeated rows count again
    df = spark.createDataFrame([(i, t, x, "p", 3, 0.5) for i, (t, x) in enumerate(rows)], KIND).repartition(4)
    got = phrases.collocations(df, least, subsumed=subsumed).collect()
    assert {(r.lang, r.phrase): (r.a, r.k, r.l, r.r, r.n, r.score) for r in got} == brute(rows, least, subsumed)
    assert len(got) == len({(r.lang, r.phrase) for r in got}) > 30


def test_stripe_totals_are_the_counts_of_prefixes(spark):
    rows = corpus(2, 80)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    first, longer = phrases.counted(df, 5)
    want = counts_of(rows)
    sums = collections.Counter()
    for r in longer.collect():
        sums[r.lang, r.prefix] += r.total
    assert sums and all(want[lang][tuple(p.split(" "))] == n for (lang, p), n in sums.items())
    words = collections.Counter()
    for r in first.collect():
        words[r.lang] += r.total
    assert words == {lang: sum(c for p, c in f.items() if len(p) == 1) for lang, f in want.items()}


def test_stripes_are_merged_across_batches(spark):
    """A key whose rows fill several batches, and neighbours that differ in one part of the key."""
    rows = [("en", "p", s, [w], [1]) for s in (0, 1) for w in ("x", None) for _ in range(300)]
    rows += [("en", "q", 0, ["x", None], [5, 7]), ("fr", "p", 0, ["x"], [2])]
    df = spark.createDataFrame(rows, phrases.STRIPE)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r.lang, r.prefix, r.segment): (r.words, r.counts, r.total) for r in phrases.merged(df, 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {("en", "p", 0): (["x"], [300], 600), ("en", "p", 1): (["x"], [300], 600),
                   ("en", "q", 0): (["x"], [5], 12), ("fr", "p", 0): ([], [], 2)}


def test_top_is_ordered_by_score_occurrences_and_bytes(spark):
    rows = [("en", p, 5, 1, 5, 5, 100, s) for p, s in (("b b", 9), ("a é", 9), ("a z", 9), ("c", 10), ("d", 1))]
    rows += [("en", "e", 6, 1, 5, 5, 100, 9), ("fr", "f", 5, 1, 5, 5, 9, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, k int, l long, r long, n long, score long")
    got = phrases.top_phrases(df, 4).orderBy("lang", "rank").collect()
    assert [(r.lang, r["rank"], r.phrase) for r in got] == [
        ("en", 1, "c"), ("en", 2, "e"), ("en", 3, "a z"), ("en", 4, "a é"), ("fr", 1, "f")]


def test_no_texts_and_no_frequent_phrases(spark):
    none = spark.createDataFrame([], KIND)
    assert phrases.collocations(none).collect() == []
    few = spark.createDataFrame([(1, "a b c", None, None, None, None)], KIND)
    assert phrases.collocations(few).collect() == []
    assert phrases.collocations(few, 1, longest=2).count() == 2


def test_corpus_of_no_words():
    empty = phrases.Corpus(pa.array([None, "..."]), pa.array([None, "en"]))
    assert list(phrases.vocabulary(empty)) == []


def test_op13_equals_sql(spark):
    ours = spark_rows(queries.op13_collocations(spark, SF.replace("0.001", "0.01")))
    assert difference(ours, sql_rows(duck(SF.replace("0.001", "0.01")), queries.SQL["op13_collocations"])) is None


def test_rows_between_tasks_are_bounded_by_buckets(spark, monkeypatch):
    """A task gave a row for each prefix, and so ever more as more prefixes become frequent."""
    monkeypatch.setattr(phrases, "BUCKETS", 8)
    rows = corpus(3, 200)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    parts = phrases.known(phrases.extended(phrases.merged(phrases.stripes(docs, None, range(0, 1), 8), 3)))
    assert phrases.stripes(docs, parts, range(1, 2), 8).count() <= 8
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), 3).collect()
    assert {(r.lang, r.phrase): (r.a, r.k, r.l, r.r, r.n, r.score) for r in got} == brute(rows, 3)
