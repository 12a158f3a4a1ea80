"""Each operator against a brute-force version on small tables with nulls, ties and repeats."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from depotflow.llm import (blocks, covertree, decontaminate, langid, licenses, neardup, pages, queries, repeats,
                           subword, suffixtree, tokenfile)
from tests.conftest import SF

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EXTRA = ", block int, key string, node string, words string, score double"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[50] = "other"
    out = [None, "", " \t\n", "one", "two words", "Été ÜBER 日本 😀 ſ", base, base, base.upper(),
           " ".join(near), f"{prose(3, 40)} {passage} {prose(4, 40)}", f"{prose(5, 30)}\n{passage}",
           "ab " * 300, "it it it " * 90, "x" * 5000, "!!! ??? ...", prose(6, 20_000, 3000)]
    return out + [prose(10 + k, 5 + 9 * k) for k in range(14)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1, "k", "n", "w", 0.5) for i, t in enumerate(texts)]
    rows += [(6, texts[6], 1, "k", "n", "w", 0.5), (None, texts[6], None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def unique(docs):
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def empty(spark, kind="doc_id long, text string"):
    return spark.createDataFrame([], kind)


# -- decontamination ----------------------------------------------------------------


def brute_contamination(texts, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        found = WORD.findall(low(text))
        n = min(13, len(found))
        for k in range(len(found) - n + 1 if n else 0):
            windows[tuple(found[k:k + n])].add(str(item))
    out = {}
    for i, text in enumerate(texts):
        found, own = WORD.findall(low(text)), set()
        hit = bytearray(len(found))
        for n in {len(w) for w in windows}:
            for k in range(len(found) - n + 1):
                if (w := tuple(found[k:k + n])) in windows:
                    own |= windows[w]
                    hit[k:k + n] = b"\1" * n
        out[i] = (len(found), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(),
                  sum(hit) > 0 and 20 * sum(hit) >= len(found))
    return out


def test_contamination_equals_brute_force(spark, docs, unique, texts):
    items = [(1, prose(2, 60)), (2, prose(2, 60)), (3, "One"), (4, "two words"), (5, None), (6, ""),
             (7, prose(6, 20_000, 3000)[:400]), (8, "no such thing at all")]
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    rows = decontaminate.contamination(unique, table).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == brute_contamination(texts, items)
    whole = decontaminate.contamination(docs, table).collect()
    assert sorted(r.n_hit for r in whole if r.doc_id == 6) == [got[6][1]] * 2
    assert [r.n_words for r in whole if r.doc_id is None] == [got[6][0]]
    left = decontaminate.clean(docs, table)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - sum(r.contaminated for r in whole)


def test_contamination_of_empty_tables(spark, unique):
    items = empty(spark, "item_id long, text string")
    assert decontaminate.contamination(unique, items).where("n_hit > 0 OR n_items > 0").count() == 0
    assert decontaminate.contamination(empty(spark), items).count() == 0


# -- suffix tree --------------------------------------------------------------------


def test_scores_of_the_root_and_gain_of_the_tree(spark, unique, texts):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    many = unique.union(spark.createDataFrame(
        [(1000 + i, f"{prose(99, 30)} {prose(i, 5)}", 1, "", "", "", 0.0) for i in range(60)], unique.schema))
    rows = suffixtree.scored(many, ~held_out, least=4, block_bytes=20_000).collect()
    all_texts = {r.doc_id: r.text for r in many.collect()}
    tokens = {i: [*SPACED.findall(low(t)), "\n"] for i, t in all_texts.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
    copies = [r for r in rows if r.doc_id >= 1000 and not r.train]
    assert copies and all(r.score > 0.6 * r.base_score for r in copies)
    one = suffixtree.scored(many, ~held_out, least=4).collect()  # however the blocks are cut
    assert {(r.doc_id, round(r.score, 6)) for r in one} == {(r.doc_id, round(r.score, 6)) for r in rows}


def test_scores_without_rows_or_training(spark, docs):
    assert suffixtree.scored(empty(spark), F.lit(True)).count() == 0
    rows = suffixtree.scored(docs, F.lit(False)).collect()
    assert len(rows) == docs.count() and all(r.score == 0 and r.n_known == 0 for r in rows)


# -- language -----------------------------------------------------------------------


def test_language_of_held_out_texts_and_odd_ones(spark):
    rng = random.Random(3)
    kinds = {"aa": ["the", "of", "and", "thing", "ening"], "bb": ["der", "und", "ßung", "keit", "über"]}
    rows = [(i, " ".join(rng.choice(kinds[lang]) + rng.choice(["", "en", "s"]) for _ in range(8)), lang)
            for i, lang in enumerate(["aa", "bb"] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table.where("doc_id < 80"))
    new = spark.createDataFrame(
        rows[80:] + [(900, None, None), (901, "", "aa"), (902, "12 !? 3", "bb"), (903, "keitkeitung", None),
                     (903, "keitkeitung", None), (904, "the " * 20_000, "x")],
        "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("old"))
    got = langid.predict(new, model).collect()
    assert len(got) == 46 and all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert all(pred[i] == lang for i, _, lang in rows[80:])
    assert [pred[i] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "aa"]
    none = langid.train(empty(spark, "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(new, none).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


# -- top k --------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 6)).astype(np.float32)
    vectors[100:160] = vectors[100]  # ties
    rows = [(i, [float(x) for x in v], "e") for i, v in enumerate(vectors)]
    rows += [(300, None, ""), (320, [1.0, None], ""), (340, [float("nan")] * 6, ""), (360, [1.0], ""),
             (None, [1.0] * 6, ""), (20, rows[20][1], "again")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = covertree.top_k(table, table.where("vec_id % 20 = 0"), 7).collect()
    whole = {i: np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))) for i, v, _ in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in [i for i in whole if i % 20 == 0]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:7]
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert len(got) == len(expected)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == expected
    none = empty(spark, "vec_id long, embedding array<float>")
    assert covertree.top_k(none, none).count() == 0
    two = table.where("vec_id IN (0, 1)")
    assert covertree.top_k(two, two.where("vec_id = 0")).count() == 1


# -- tokens -------------------------------------------------------------------------


def test_subwords_equal_the_library(spark, docs, texts):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    odd = ["".join(rng.choice("aabinngg ▁\n\té日ﬁ\x00😀the") for _ in range(rng.randrange(60))) for _ in range(400)]
    coder = subword.Coder(path)
    for some in (odd, [t or "" for t in texts], [" " * 300 + "a" * 3000, "▁▁ x"]):
        all_ids, begin, spelled = coder.texts([t.encode() for t in some])
        for i, (text, (names, back)) in enumerate(zip(some, spelled, strict=True)):
            ids = library.encode(text)
            assert all_ids[begin[i]:begin[i + 1]].tolist() == ids
            assert (names.decode(), back.decode()) == (",".join(map(str, ids)), library.decode(ids))
            assert coder.model.decode(ids).decode() == library.decode(ids)
    rows = subword.encoded(docs, path, with_ids=True).collect()
    assert len(rows) == docs.count()
    assert all(r.ids == library.encode(texts[6 if r.doc_id is None else r.doc_id] or "") for r in rows)
    assert subword.encoded(empty(spark), path).count() == 0
    assert subword.encoded(docs, path, with_text=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_kept_segments_are_bounded(monkeypatch):
    """Segments that no longer fit are learnt anew, with the same ids."""
    path = queries.tokenizer("piece_bpe_32k.model")
    monkeypatch.setattr(subword, "CACHED", 40 * subword.ENTRY)
    coder, free = subword.Coder(path), subword.Coder(path)
    for seed in range(6):
        some = [prose(seed, 30).encode()]
        ids, _, spelled = coder.texts(some)
        monkeypatch.setattr(subword, "CACHED", 1 << 30)
        want, _, named = free.texts(some)
        monkeypatch.setattr(subword, "CACHED", 40 * subword.ENTRY)
        assert ids.tolist() == want.tolist() and list(spelled) == list(named) and len(coder.known) <= 60


def test_token_files_equal_the_library(spark, unique, docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    more = ["don't <|endoftext|>I'll x", "A<|ENDOFTEXT|>b é́ İΣς ½ \x1f", "N1234,5.6--é!!É"]
    ids, counts = tokenfile.WordCoder(path).texts(pa.array([*more, None], pa.string()), 1)
    assert ids.tolist() == [i for t in [*more, ""] for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
    got = sorted(tokenfile.token_files(unique, path, length=16).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in got:
        own = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert tokenfile.token_files(docs, path).count() == docs.count()
    assert tokenfile.token_files(empty(spark), path).count() == 0


def test_sequences_and_masks_are_read_in_place(spark, unique, tmp_path):
    path = queries.tokenizer("word_bpe_49k.json")
    tokenfile.write(unique, f"file://{tmp_path}/t", path, length=8, parts=1)
    reader = tokenfile.PartReader(f"{tmp_path}/t", 0)
    total = int(np.sum(reader.index["n_tokens"].to_numpy()))
    flat = reader.ids(0, total)
    first, mask = reader.sequence(2)
    assert first.tolist() == flat[16:24].tolist() and mask.all()
    last, mask = reader.sequence((total - 1) // 8)
    assert int(mask.sum()) == (total - 1) % 8 + 1 and (last[~mask] == 0).all()


# -- pages and licences -------------------------------------------------------------


def test_main_text_of_pages(spark):
    page = ('<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">home</a></li></ul>'
            '</nav><div class="ad">Buy &amp; pay.</div><article><h1>Head &amp;  line</h1><p><b>First<br>text of a'
            ' long story here.<p>Second\n part &eacute;.<script>x="</p>"</script></p></article><footer>&copy; me'
            '</footer></body></html>')
    rows = [(i, "u", page, "x") for i in range(30)] + [(50, None, None, ""), (51, "u", "", ""), (51, "u", "", ""),
            (52, "u", "<p>" + "word " * 50_000, ""), (None, "u", page, ""), (53, "u", "<<<a <p", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(table, pages.train(table)).collect()
    want = "Head & line\nFirst text of a long story here.\nSecond part é."
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == want for r in got if r.page_id is None or r.page_id < 30)
    assert [r.text for r in got if r.page_id in (50, 51)] == [""] * 3
    none = empty(spark, "page_id long, url string, html string")
    assert pages.extract(none, pages.train(none)).count() == 0


@pytest.fixture(scope="module")
def field():
    return pages.fit(list(pages.example_pages()))


def test_examples_of_layouts_are_learned(field):
    assert all(field.label(found) == labels for found, labels in pages.example_pages())


STORY = ('<html{html}><body{body}><div class="top menu"><a href="/">home</a></div>{open}<h1>Head of it</h1><p>First text of a '
         'long story here.</p><ul><li>a point</li></ul><p>The last words of it.</p>{inner}{close}<div class="page-footer">'
         'Imprint</div></body></html>')
WANT = "Head of it\nFirst text of a long story here.\na point\nThe last words of it."


@pytest.mark.parametrize("html,body", [("", ""), ("", ' class="has-sidebar"'), (' class="header-fixed"', ""),
                                       (' class="no-ads"', ' class="comments sidebar" id="menu"')])
@pytest.mark.parametrize("opened,closed", [
    ("<article>", "</article>"), ('<article class="post comments-open">', "</article>"), ("<main><article>", "</article></main>"),
    ('<main class="sidebar"><div class="post">', "</div></main>"), ('<div class="post">', "</div>"),
    ('<div class="has-sidebar"><div id="x1">', "</div></div>")])
@pytest.mark.parametrize("inner", ["", '<div class="thread"><p>I think so too, at some length.</p><p>Not me.</p></div>',
                                   '<div id="comments-12"><div><p>A remark of a reader.</p></div></div>',
                                   '<aside>Read also this</aside>', '<div class="ad-box">Buy now</div>'])
def test_layouts_do_not_change_the_main_text(field, html, body, opened, closed, inner):
    page = STORY.format(html=html, body=body, open=opened, close=closed, inner=inner)
    assert field.text(page) == WANT


def test_no_page_changes_by_an_outer_class(spark):
    rows = queries.table(spark, SF, "pages")
    model = pages.train(rows)
    for page in [r.html for r in rows.limit(60).collect()]:
        for tag, names in (("body", "has-sidebar"), ("html", "header-fixed"), ("article", "post comments-open")):
            assert model.text(re.sub(f"<{tag}[^>]*>", f'<{tag} class="{names}">', page)) == model.text(page)


def every_labelling(n):
    return itertools.product((0, 1), repeat=n)


def score(model, found, labels):
    rows = [model.weights[[model.names[f] for f in own if f in model.names]].sum(axis=0) for own in pages.features(found)]
    return (model.start[labels[0]] + sum(r[y] for r, y in zip(rows, labels))
            + sum(model.step[a, b] for a, b in zip(labels, labels[1:])))


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(5)
    short = [found[:k] for k, (found, _) in zip((1, 2, 3, 5, 6, 8, 4, 7) * 3, pages.example_pages())]
    names = sorted({f for found in short for own in pages.features(found) for f in own})
    for found in short:
        model = pages.Field({f: i for i, f in enumerate(names)}, rng.normal(size=(len(names), 2)), rng.normal(size=2),
                            rng.normal(size=(2, 2)))
        best = max(every_labelling(len(found)), key=lambda y: score(model, found, y))
        assert model.label(found) == [bool(y) for y in best]


def test_training_ends_where_the_likelihood_is_highest():
    """At the weights that are found, the slope of the penalised likelihood, by all labellings, is about zero."""
    some = [(found[:5], labels[:5]) for found, labels in list(pages.example_pages())[:3]]
    model = pages.fit(some, rounds=3000, ridge=0.1)

    def value(model):
        total = 0.0
        for found, labels in some:
            scores = [score(model, found, y) for y in every_labelling(len(found))]
            total += score(model, found, [int(y) for y in labels]) - np.logaddexp.reduce(scores)
        flat = np.concatenate([model.weights.ravel(), model.start, model.step.ravel()])
        return total / len(some) - 0.05 * (flat ** 2).sum()

    for part in (model.weights, model.start, model.step):
        flat = part.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 25)):
            kept, ends = flat[i], []
            for move in (1e-4, -1e-4):
                flat[i] = kept + move
                ends.append(value(model))
            flat[i] = kept
            assert abs(ends[0] - ends[1]) / 2e-4 < 5e-3


def test_licences_are_found_and_inherited(spark):
    mit, gpl = "x\nReleased under the MIT License.\ny", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"
    rows = [("/a/LICENSE", gpl), ("/a/b/c/f.py", "code"), ("/a/b/g.py", mit), ("/a/b/c/LICENSE.txt", mit),
            ("/z/f.py", "the of and"), ("/z/e", None), (None, "text"), ("/a/b/h.py", ""), ("/a/b/h.py", ""),
            ("/z/long", "some words of it " * 20_000), ("LICENSE", "nothing"), ("/ab/f", "text")]
    table = spark.createDataFrame([(*r, "o") for r in rows], "path string, text string, licence string")
    got = [(r.path, r.licence, r.origin, r.licence_dir) for r in licenses.scan(table).collect()]
    assert sorted(got, key=str) == sorted([
        ("/a/LICENSE", "GPL-3.0", "own", None), ("/a/b/c/f.py", "MIT", "inherited", "/a/b/c"),
        ("/a/b/g.py", "MIT", "own", None), ("/a/b/c/LICENSE.txt", "MIT", "own", None), ("/z/f.py", None, None, None),
        ("/z/e", None, None, None), (None, None, None, None), ("/a/b/h.py", "GPL-3.0", "inherited", "/a"),
        ("/a/b/h.py", "GPL-3.0", "inherited", "/a"), ("/z/long", None, None, None), ("LICENSE", None, None, None),
        ("/ab/f", None, None, None)], key=str)
    assert licenses.scan(empty(spark, "path string, text string")).count() == 0


# -- duplicates ---------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(
            b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 1])
def test_repeats_equal_brute_force(spark, unique, texts, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_SEGMENTS", most)  # 1: every shared k-gram is a crowded one
    shared = prose(7, 40)
    more = [f"{prose(200 + k, 10)} {shared[:150 + 9 * k]} {prose(300 + k, 10)}" for k in range(12)]
    table = unique.select("doc_id", "text").union(spark.createDataFrame(
        [(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    rows = sorted(repeats.repeats(table, length=60, block_bytes=30_000).collect(), key=lambda r: r.doc_id)
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert got == brute_repeats(texts + more, 60)


def test_repeats_of_equal_rows_and_empty_tables(spark, docs):
    rows = repeats.repeats(docs, keep=["block", "key"]).collect()
    assert len(rows) == docs.count()
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (6, None))
    assert repeats.repeats(empty(spark)).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        found = SPACED.findall(low(t))
        sets.append({tuple(found[k:k + 3]) for k in range(max(1, len(found) - 2))} if found else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return [(len(s), r, r == i) for i, (s, r) in enumerate(zip(sets, root, strict=True))]


def test_near_duplicates_equal_brute_force(spark, unique, docs, texts):
    base, more = prose(50, 150).split(), []
    for k in range(40):  # a chain of edits: neighbours are near, the ends are not
        base = [*base]
        base[(7 * k) % 150] = f"edit{k}"
        more.append(" ".join(base))
    table = unique.select("doc_id", "text").union(spark.createDataFrame(
        [(len(texts) + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    rows = sorted(neardup.near_duplicates(table).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows] == brute_components(texts + more)
    whole = neardup.near_duplicates(docs).collect()
    assert len(whole) == docs.count()
    assert [(r.component_id, r.kept) for r in whole if r.doc_id is None] == [(6, False)]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_dense_regions_are_compared_across_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NEXT", 1)
    texts = []
    for k in range(30):
        words = prose(60, 100).split()
        words[k] = f"edit{k}"
        texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = neardup.near_duplicates(table).collect()
    assert {r.component_id for r in rows} == {0}


@pytest.mark.parametrize("chunk,sets", [(2048, 8 << 20), (7, 9000)])
def test_dense_regions_give_rows_by_classes_not_by_pairs(spark, monkeypatch, chunk, sets):
    """Texts of one template, most pairs just below the threshold and some just above it."""
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "SETS", sets)
    counted = {}
    for name in ("crowded", "joined"):
        plain = getattr(neardup, name)

        def kept(*args, name=name, plain=plain):
            made = plain(*args)
            counted[f"{name}_rows"] = made.count()
            return made

        monkeypatch.setattr(neardup, name, kept)
    rng, template = random.Random(3), prose(61, 300).split()
    texts = []
    for k in range(100):
        words = [*template]
        for place in rng.sample(range(300), rng.choice([3, 5, 6, 6, 6, 7])):
            words[place] = f"edit{k}x{place}"
        texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(neardup.near_duplicates(table).collect(), key=lambda r: r.doc_id)
    roots = brute_near(texts, 3, 85)
    assert [r.component_id for r in rows] == roots
    assert 10 < len(set(roots)) < 100
    trees = neardup.planned(85).trees
    assert counted["crowded_rows"] <= 100 * trees < 100 * 99 / 2 and counted["joined_rows"] < 2000


def test_recall_of_pairs_about_the_threshold(spark):
    """Planted pairs just above the threshold are all linked, those just below are not."""
    texts, near = [], []
    for k in range(60):
        words = prose(900 + k, 300, 5000).split()
        for edits in ([], range(20, 290, 60 if k % 2 else 15)):
            mine = [*words]
            for place in edits:
                mine[place] = f"edit{place}"
            texts.append(" ".join(mine))
    roots = brute_near(texts, 3, 85)
    near = [i for i, r in enumerate(roots) if i != r]
    rows = sorted(neardup.near_duplicates(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in rows] == roots and len(near) == 30


# -- pipeline -----------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, texts, tmp_path):
    lang = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(99, lang, "en", "s", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, prose(14, 41))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    roots = brute_near([t for _, t in left], 5, 80)  # as the stage takes them
    left = [row for k, (row, root) in enumerate(zip(left, roots, strict=True)) if k == root]
    cut = []
    for (i, t), (size, gone, _, digest) in zip(left, brute_repeats([t for _, t in left], 200), strict=True):
        if not gone:
            cut.append((i, t))
        elif gone < size:
            cut.append((i, digest))
    judged = brute_contamination([t for _, t in cut], items)
    want = [i for k, (i, _) in enumerate(cut) if not judged[k][4]]
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == want
    whole = {i: t for i, t in cut}
    same = [r for r in got if whole[r.doc_id] == rows[min(r.doc_id, len(rows) - 1)][1]]
    assert same and all(r.decoded_sha256 == hashlib.sha256(whole[r.doc_id].encode()).hexdigest() for r in same)


def brute_near(texts, size, threshold):
    """The least index that each text reaches over links."""
    sets = []
    for t in texts:
        found = SPACED.findall(low(t))
        sets.append({tuple(found[k:k + size]) for k in range(max(1, len(found) - size + 1))})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    texts = []
    for k in range(12):
        base = prose(700 + k, 200 + 10 * k)
        words = base.split()
        edited = [*words]
        for place in range(5, len(words), 18 + k):  # by three words closer than by five
            edited[place] = f"edit{place}"
        texts += [base, f"{base} {prose(800 + k, len(words) // 5)}", " ".join(edited)]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, table, "").collect())
    root = brute_near(texts, 5, 80)
    assert kept == [i for i, r in enumerate(root) if i == r]
    assert root != brute_near(texts, 3, 85)


@pytest.mark.parametrize("threshold", [80, 85])
def test_pairs_at_the_threshold_are_not_missed_by_plan(threshold):
    plan, like = neardup.planned(threshold), threshold / 100
    assert (1 - like ** plan.shallow) ** plan.trees <= neardup.MISS
    short = neardup.NUMBERS * like - plan.agree
    assert short >= 6 * math.sqrt(neardup.NUMBERS * like * (1 - like))
    firsts = plan.orders[:, :plan.shallow].ravel()
    assert len(set(firsts.tolist())) == len(firsts)


def brute_scores(rows, least, depth=2, shares=(0.02, 0.1, 0.3, 0.6), gain=4.0):
    """log10 scores of (text, train) rows by the whole suffix tree, as the module describes it."""
    tokens = [([*SPACED.findall(low(t)), "\n"], train) for t, train in rows]
    seen = [collections.Counter() for _ in range(depth + 1)]  # training counts of pairs, by length of context
    for own, train in tokens:
        for i in range(len(own) if train else 0):
            for n in range(min(i, depth) + 1):
                seen[n][tuple(own[i - n:i + 1])] += 1
    total, types = sum(seen[0].values()), len(seen[0])
    states = {}  # context: share of its parent

    def p(own, i, upto, less):
        out = (seen[0][own[i],] + 1) / (total + types + 1)
        for n in range(1, min(i, upto) + 1):
            context = tuple(own[i - n:i])
            if context in states:
                times, count = seen[n][(*context, own[i])] - less, seen[n - 1][context] - less
                out = (1 - states[context]) * times / max(count, 1) + states[context] * out
        return out

    for n in range(1, depth + 1):
        gains = collections.defaultdict(lambda: [0] * len(shares))
        for own, train in tokens:
            for i in range(n, len(own) if train else 0):
                context = tuple(own[i - n:i])
                if seen[n - 1][context] >= least and (n == 1 or seen[n - 2][context[:-1]] >= least):
                    ratio = ((seen[n][(*context, own[i])] - 1) / max(seen[n - 1][context] - 1, 1)
                             / p(own, i, n - 1, 1))
                    for k, share in enumerate(shares):
                        gains[context][k] += round(math.log((1 - share) * ratio + share) * 64)
        for context, sums in gains.items():
            if max(sums) >= gain * 64:
                states[context] = shares[sums.index(max(sums))]
    return [sum(math.log10(p(own, i, depth, 0)) for i in range(len(own))) for own, _ in tokens], states


def test_contexts_seen_eight_times_become_states(spark):
    rng = random.Random(8)
    rows = [(" ".join(f"w{rng.randrange(60)}" for _ in range(40)) + " rare cue goes here" * (i % 5 == 0)
             + " w1 w2 end" * (i % 4 == 0), True) for i in range(40)]
    rows += [("w5 rare cue goes here w1 w2 end", False), ("cue goes here w3 w1 w2 end", False)]
    want, states = brute_scores(rows, 8)
    assert ("rare",) in states and ("rare", "cue") in brute_scores(rows, 8, gain=-1e9)[1]
    table = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "doc_id long, text string, train boolean")
    got = sorted(suffixtree.scored(table, F.col("train"), block_bytes=2000).collect(), key=lambda r: r.doc_id)
    assert [round(r.score, 6) for r in got] == [round(x, 6) for x in want]


def test_held_out_texts_get_the_counts_of_words_seen_once(spark):
    rows = [(f"{prose(900 + i, 30, 12)} the name known {prose(i, 5, 90)} the name known {prose(i + 50, 5, 90)} "
             f"the name once{i}", i % 3 != 0) for i in range(45)]
    rows += [(t, not train) for t, train in rows]  # a held-out copy of each
    want, states = brute_scores(rows, 8)
    assert ("name",) in states
    table = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "doc_id long, text string, train boolean")
    got = sorted(suffixtree.scored(table, F.col("train"), block_bytes=8000).collect(), key=lambda r: r.doc_id)
    assert [round(r.score, 6) for r in got] == [round(x, 6) for x in want]


def test_wrapped_and_embedded_notices(spark):
    gpl3 = "   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Copyright (C) 2007 someone"
    mit = " ".join(dict(licenses.WHOLE)["MIT"].split())
    rows = [("/g/LICENSE", gpl3), ("/g/sub/x.c", "int main"),
            ("/g2/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n" + prose(1, 50)),
            ("/w/a.py", "# Licensed under the Apache License,\n# Version 2.0.\n" + prose(2, 300)),
            ("/w/b.py", f"{prose(3, 200)} this one is released under the MIT License. {prose(4, 200)}"),
            ("/w/c.py", "Released under\nthe MIT\nLicense."), ("/w/d.py", prose(5, 300)),
            ("/m/LICENSE", "Copyright me. " + mit.replace("hereby granted, free", "granted, without any fee or free")
             .replace(" to any person obtaining a copy", " unto each and every body that has got hold of a copy")),
            ("/m/f", prose(6, 30)),
            ("/w/e.py", None), ("/w/f.py", "Released under"), ("/w/g.py", "the MIT License.")]
    table = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(table).collect()}
    assert got == {
        "/g/LICENSE": ("GPL-3.0", "own"), "/g/sub/x.c": ("GPL-3.0", "inherited"), "/g2/COPYING": ("GPL-2.0", "own"),
        "/w/a.py": ("Apache-2.0", "own"), "/w/b.py": ("MIT", "own"), "/w/c.py": ("MIT", "own"),
        "/w/d.py": (None, None), "/m/LICENSE": ("MIT", "own"), "/m/f": ("MIT", "inherited"),
        "/w/e.py": (None, None), "/w/f.py": got["/w/f.py"], "/w/g.py": got["/w/g.py"]}


def test_windows_equal_brute_force():
    rng = random.Random(12)
    lengths = [3, 5]
    for _ in range(30):
        files = [[rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(4)]
        flat = [w for f in files for w in f]
        owner = np.array([i for i, f in enumerate(files) for _ in f], int)
        idf, unseen = np.array([1.0, 2.0, 1.5, 3.0]), 4.0
        matrix = np.array([[1, 0], [1, 2], [0, 1], [2, 0]]) / np.sqrt([6, 5])
        term = np.array([w if w < 4 else -1 for w in flat], int)
        found = np.zeros(4), np.zeros(4, np.int64)
        licenses.best_windows(found, (term, None, owner, np.array(flat, int)), idf, unseen, matrix, lengths, 0.5)
        for i, f in enumerate(files):
            best = 0.0
            for k, n in enumerate(lengths):
                for j in range(max(len(f) - n, 0) + 1 if f else 0):
                    times = collections.Counter(f[j:j + n])
                    norm = math.sqrt(sum((c * (idf[w] if w < 4 else unseen)) ** 2 for w, c in times.items()))
                    best = max(best, sum(c * idf[w] * matrix[w, k] for w, c in times.items() if w < 4) / norm)
            assert math.isclose(found[0][i], min(best, 1.0) if best >= 0.5 else 0.0, abs_tol=1e-9)


def test_pairs_at_the_threshold_are_missed_no_more_than_by_24_trees_of_4():
    plan = neardup.planned(neardup.THRESHOLD)
    assert (1 - 0.85 ** plan.shallow) ** plan.trees <= (1 - 0.85 ** 4) ** 24


def test_one_row_of_each_component_whatever_the_ids(spark):
    a, b, c = (prose(910 + k, 150) for k in range(3))
    near = [" ".join([*t.split()[:-1], "other"]) for t in (a, b, c)]
    rows = [(1, a), (2, near[0]), (2, b), (3, near[1]),  # id 2 is kept by one text and not by the other
            (5, c), (5, near[2]), (5, c), (None, prose(920, 150)), (None, f"{prose(920, 150)} end"), (None, a),
            (7, ""), (7, ""), (None, None)]
    table = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, table, "").collect()), key=str)
    least = [min(ts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
             for ts in ((c, near[2]), (prose(920, 150), f"{prose(920, 150)} end"))]
    assert got == sorted([(1, a), (2, b), (5, least[0]), (None, least[1]), (7, ""), (None, None)], key=str)


def test_memory_of_a_slice_and_of_windows():
    """A task held some 60 bytes for each byte of a 4 MB slice, and window arrays of a megabyte of starts."""
    rng = np.random.default_rng(5)
    words = [f"w{i} " for i in range(5000)]
    text = "".join(words[i] for i in rng.integers(0, 5000, 1 << 18))
    coder = subword.Coder(queries.tokenizer("piece_bpe_32k.model"))
    part = pa.RecordBatch.from_pydict({"text": [text[k:k + 4000] for k in range(0, len(text), 4000)]})
    size = next(iter(subword.slices(part, "text", subword.SLICE))).num_rows
    coder.texts([t.encode() for t in part["text"].to_pylist()[:size]])
    tracemalloc.start()
    try:
        coder.texts([t.encode() for t in part["text"].to_pylist()[:size]])
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.reset_peak()
        data = np.frombuffer(text.encode(), np.uint8)
        repeats.segments(data, np.array([0, len(data)]), 200)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_keys_travel_as_steps():
    """They took five bytes each; as steps from key to key they take less and still meet in a bucket."""
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for n in (1, 3, 100):
        some, others = keys[::2], keys[::3]
        told = [blocks.say(b, 0, k, np.ones((len(k), 1), np.int64), n, 5) for b, k in ((0, some), (1, others))]
        met = 0
        for bucket in range(n):
            one, two = (np.cumsum(blocks.unpack(t["keys"][bucket].as_py(), np.uint64), dtype=np.uint64) for t in told)
            met += len(np.intersect1d(one, two))
            assert len(np.unique(one)) == len(one) == int((blocks.bucket_of(some, n) == bucket).sum())
        assert met == len(np.intersect1d(some, others))
    assert sum(map(len, told[0]["keys"].to_pylist())) < 4.9 * len(some)
