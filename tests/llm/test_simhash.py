"""SimHash fingerprints and links against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from depotflow.llm import queries, simhash
from tests.conftest import SF

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """Least id that each (id, fingerprint) row reaches."""
    left, out = set(range(len(rows))), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            near = {j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= 3}
            left -= near
            todo += near
        least = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
        out.update(dict.fromkeys(seen, least))
    return [out[i] for i in range(len(rows))]


def test_xxh64_equals_the_library():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    starts = np.array([rng.randrange(2900) for _ in range(2000)] + [0, 2999, 3000])
    lengths = np.array([rng.randrange(0, 100) for _ in range(2000)] + [3000, 1, 0])
    got = simhash.xxh64(np.frombuffer(data, np.uint8), starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s:s + n], 42) for s, n in zip(starts, lengths)]


def test_fingerprints_of_odd_texts():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "two Words", "a  b\nc", "É X y z w", "ab " * 600, "x" * 5000, "it it it " * 300]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(3000))) for _ in range(12)]
    assert simhash.fingerprint_all(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]
    assert simhash.fingerprint_all(pa.array([], pa.string())).tolist() == []


def test_near_tiles_equal_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    marks = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)])
    own = np.arange(0, 120)
    root = simhash.near_tiles(marks, own, 0)
    near = np.bitwise_count(marks[:, None] ^ marks[None]) <= 3
    near[120:, 120:] = False
    i, j = np.nonzero(near)
    assert (root == simhash.joined_by(np.arange(len(marks)), i, j)).all()
    # what was compared before is not compared again
    assert (simhash.near_tiles(marks, own, 200) == np.arange(200)).all()


@pytest.mark.parametrize("tile,small,piece", [(1 << 13, 64, 1 << 11), (4, 0, 3)])
def test_components_equal_brute_force(spark, monkeypatch, tile, small, piece):
    """Chains over pairs at most three bits apart, in large tiles and in small ones."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    marks = [0, 0, (1 << 64) - 1]
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            marks.append(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                at ^= 1 << b
    classes = spark.createDataFrame([(m.to_bytes(8, "big"),) for m in sorted(set(marks))], "fingerprint binary")
    from depotflow.llm.neardup import components as joined

    def found():
        if small != 64:  # in tasks too, which have their own copy of the module's values
            return simhash.links(classes.repartition(3))
        return simhash.links(classes)

    roots = {bytes(r.node): bytes(r.root) for r in joined(found()).collect()}
    names = [m.to_bytes(8, "big") for m in marks]
    want = components(list(zip(marks, marks)))
    groups = {}
    for name, least in zip(names, want):
        groups.setdefault(least, set()).add(roots.get(name, name))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_near_duplicates_with_nulls_ties_and_repeats(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    near = list(base)
    near[7] = "other"
    texts = [None, "", "one two", " ".join(base), " ".join(base).upper(), " ".join(near), "tail", "One  TWO",
             " ".join(base[:200])]
    rows = [(i, t, "f", 1, "r") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "f", 1, "r"), (None, texts[6], None, None, None), (6, "quite another text here", "f", 1, "r"),
             (None, "alone without an id " * 3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n int, root string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    plain = [(r[0], fingerprint(r[1])) for r in rows]
    want = sorted((str(i), f"{m:016x}", str(c)) for (i, m), c in zip(plain, components(plain)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert simhash.near_duplicates(df.where("doc_id = 6 AND text = 'tail'")).count() == 1


def test_op12_over_the_table(spark):
    rows = [(r.doc_id, fingerprint(r.text)) for r in queries.table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, SF).collect()}
    assert got == {i: (f"{m:016x}", c) for (i, m), c in zip(rows, components(rows))}
