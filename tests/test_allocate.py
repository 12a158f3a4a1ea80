"""Allocation and reservation against running the requests one after the other."""

import random
from decimal import Decimal as D

import pytest

from depotflow.operators import allocate as allocation
from depotflow.operators import connected
from depotflow.operators.allocate import allocate
from depotflow.operators.connected import components
from depotflow.operators.reserve import reserve
from depotflow.operators.running import line_ids, prior_value, ranked, running_totals
from pyspark.sql import functions as F


def one_by_one(docs, lines, free):
    left, accepted, reasons = dict(free), {}, {}
    for doc in sorted(docs):
        mine = sorted((no, r, q) for d, r, q, no in lines if d == doc)
        short = [r for no, r, q in mine if left[r] is not None and q > left[r]]
        accepted[doc] = not short
        if short:
            reasons[doc] = short[0]
        else:
            for _, r, q in mine:
                if left[r] is not None:
                    left[r] -= q
    return accepted, reasons


@pytest.mark.parametrize("seed", range(4))
def test_allocate_equals_one_by_one(spark, seed):
    rnd = random.Random(seed)
    # resource 0 is in most documents; resource 7 has no limit
    free = {r: D(rnd.randint(0, 4000)) / 100 for r in range(7)} | {7: None}
    docs = rnd.sample(range(10_000), 120)
    lines = []
    for doc in docs:
        wanted = set(rnd.sample(range(8), rnd.randint(0, 3))) | ({0} if rnd.random() < 0.6 else set())
        lines += [(doc, r, D(rnd.randint(1, 900)) / 100, no)
                  for no, r in enumerate(rnd.sample(sorted(wanted), len(wanted)))]
    accepted, reasons = one_by_one(docs, lines, free)
    line_rows = spark.createDataFrame(
        [(d, r, q, no, free[r]) for d, r, q, no in lines],
        "doc long, resource long, need decimal(12,2), line_no long, free decimal(12,2)")
    doc_rows = spark.createDataFrame([(d,) for d in docs], "doc long")
    got = allocate(doc_rows, line_rows, ["resource"], span=512)
    assert {r.doc: r.accepted for r in got.verdicts.collect()} == accepted
    assert {r.doc: r.resource for r in got.failed().collect()} == reasons
    assert 0 < sum(accepted.values()) < len(docs)


def as_rows(spark, lines, free):
    return spark.createDataFrame(
        [(d, r, q, no, free[r]) for d, r, q, no in lines],
        "doc long, resource long, need decimal(12,2), line_no long, free decimal(12,2)")


def test_a_chain_of_documents_takes_few_writes(spark, monkeypatch):
    """Each document shares a resource with the next one, so its verdict follows from the one before."""
    n = 200
    free = {r: D(1) for r in range(n + 1)}
    lines = [(d, d + e, D(1), e) for d in range(n) for e in (0, 1)]
    writes = []
    for module in (allocation, connected):
        plain = module.durable
        monkeypatch.setattr(module, "durable", lambda df, plain=plain: writes.append(1) or plain(df))
    got = allocate(spark.range(n).withColumnRenamed("id", "doc"), as_rows(spark, lines, free), ["resource"])
    assert {r.doc: r.accepted for r in got.verdicts.collect()} == {d: d % 2 == 0 for d in range(n)}
    assert len(writes) <= 12
    assert {r.doc: r.resource for r in got.failed().collect()} == {d: d for d in range(1, n, 2)}


@pytest.mark.parametrize("seed", range(2))
def test_reasons_are_those_of_each_turn(spark, seed):
    """Documents that were refused ask again, when less is free."""
    rnd = random.Random(seed)
    free = {r: D(rnd.randint(5, 60)) for r in range(6)}
    lines = [(d, r, D(rnd.randint(1, 12)), no) for d in range(60) for no, r in enumerate(rnd.sample(range(6), 3))]
    turns = [(d, d) for d in range(60)] + [(d, 60 + i) for i, d in enumerate(rnd.sample(range(60), 60))]
    left, accepted, reasons = dict(free), set(), {}
    for d, t in sorted(turns, key=lambda x: x[1]):
        short = [(r, left[r], q) for d2, r, q, _ in lines if d2 == d and q > left[r]]
        if d in accepted:
            continue
        if short:
            reasons[t] = short[0]
        else:
            accepted.add(d)
            for d2, r, q, _ in lines:
                left[r] -= q if d2 == d else 0
    got = allocate(spark.range(60).withColumnRenamed("id", "doc"), as_rows(spark, lines, free), ["resource"], span=16)
    asked = spark.createDataFrame(turns, "doc long, turn long")
    assert {r.turn: r.resource for r in got.failed(asked).collect()} == {t: x[0] for t, x in reasons.items()}
    assert {r.turn: (r.resource, r.left, r.need) for r in got.failed(asked, left=True).collect()} == reasons


@pytest.mark.parametrize("most", [1 << 18, 7])
def test_components_in_one_task_and_in_many(spark, most):
    rnd = random.Random(most)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (7, 6)]
    pairs += [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(-5, 1 << 60)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[find(a)] = find(b)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(df, most).collect()}
    assert set(got) == set(root)
    groups = {}
    for n in root:
        groups.setdefault(find(n), set()).add(got[n])
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)
    assert components(df.limit(0), most).collect() == []


def test_allocate_without_contention(spark):
    docs = spark.range(5).withColumnRenamed("id", "doc")
    lines = docs.selectExpr("doc", "1L AS resource", "1.00BD AS need", "5.00BD AS free",
                            "0L AS line_no")
    got = allocate(docs, lines, ["resource"])
    assert got.verdicts.filter("accepted").count() == 5 and got.failed().isEmpty()


def greedy(rows):
    left, taken, verdicts, seen = {}, set(), {}, {}
    for item, seq, pair, qty, free in sorted(rows, key=lambda r: r[1]):
        now = left.setdefault(item, free)
        seen[seq] = now
        if (item, pair) in taken:
            verdicts[seq] = "duplicate"
        elif now is not None and now < qty:
            verdicts[seq] = "short"
        else:
            verdicts[seq] = "accepted"
            taken.add((item, pair))
            if now is not None:
                left[item] = now - qty
    return verdicts, seen


@pytest.mark.parametrize("seed,fold_limit", [(1, 10**6), (2, 40), (3, 0)])
def test_reserve_equals_one_by_one(spark, seed, fold_limit):
    rnd = random.Random(seed)
    free = {i: None if i == 3 else D(rnd.randint(0, 60_000)) / 100 for i in range(6)}
    pairs = 50 if seed == 3 else 10**9  # few pairs make duplicates
    rows = []
    for seq in rnd.sample(range(5000), 400):
        item = rnd.choice([0, 0, 0, 0, 1, 2, 3, 4, 5])
        qty = D(int(rnd.paretovariate(0.6) * 100) % 90_000 + 1) / 100
        rows.append((item, seq, rnd.randint(0, pairs), qty, free[item]))
    verdicts, seen = greedy(rows)
    df = spark.createDataFrame(
        rows, "item_id long, req_seq long, pair long, qty decimal(12,2), free decimal(12,2)")
    got = reserve(df, fold_limit, span=64).collect()
    assert {r.req_seq: r.verdict for r in got} == verdicts
    for r in got:
        if r.verdict == "short":
            assert r.available == seen[r.req_seq]


def test_a_small_request_passes_after_a_refused_large_one(spark):
    df = spark.sql("""SELECT 1L AS item_id, seq AS req_seq, seq AS pair, qty, 10.00BD AS free
        FROM VALUES (1L, 4.00BD), (2L, 7.00BD), (3L, 6.00BD), (4L, 0.01BD) AS t(seq, qty)""")
    for limit in (100, 0):
        got = {r.req_seq: r.verdict for r in reserve(df, limit).collect()}
        assert got == {1: "accepted", 2: "short", 3: "accepted", 4: "short"}


def test_running_totals_over_spans(spark):
    rnd = random.Random(5)
    rows = [(k, o, rnd.randint(1, 9)) for k in (0, 1) for o in rnd.sample(range(300), 90)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = {(r.k, r.o): r.before for r in
           running_totals(df, ["k"], "o", {"before": F.col("v")}, span=16).collect()}
    for k, o, _ in rows:
        assert got[k, o] == sum(v for k2, o2, v in rows if k2 == k and o2 < o)


def test_prior_value_and_rank_over_spans(spark):
    df = spark.createDataFrame([(1, o, f"s{o}") for o in (3, 9, 40, 41, 99)], "k long, o long, v string")
    got = {r.o: r.p for r in prior_value(df, ["k"], "o", "v", "p", span=8).collect()}
    assert got == {3: None, 9: "s3", 40: "s9", 41: "s40", 99: "s41"}
    assert {r.o: r.nr for r in ranked(df, "o", "nr", span=8).collect()} == {
        3: 1, 9: 2, 40: 3, 41: 4, 99: 5}


def test_sparse_orders_are_cut_by_digits_and_lines_get_ids_of_their_own(spark):
    rows = [(1, i * 10**6 - 5 * 10**7, i) for i in range(100)] + [(2, 2**40, 7), (2, 3, None)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = {(r.k, r.o): r.before for r in running_totals(df, ["k"], "o", {"before": F.col("v")}, span=16).collect()}
    assert got == {(1, i * 10**6 - 5 * 10**7): i * (i - 1) // 2 for i in range(100)} | {(2, 3): 0, (2, 2**40): 0}
    lines = spark.createDataFrame([(5, 1), (4, 1_000_001), (4, 2)], "doc long, item long")
    ids = {(r.doc, r.item): r.id for r in line_ids(lines, "doc", "item", "id").collect()}
    assert ids == {(4, 2): 1, (4, 1_000_001): 2, (5, 1): 3}
