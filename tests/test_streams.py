"""Streams: slices, restarts and batches run twice."""

import random
from decimal import Decimal as D

import pytest

from depotflow.plans.procurement import confirm_grn
from depotflow.session import fresh_path
from depotflow.sources.snapshots import SnapshotStore
from depotflow.streaming import ledger, transitions
from depotflow.streaming.feed import ordered_stream, run_to_end, stream_table
from depotflow.streaming.receipts import confirm_stream
from tests.small import AS_OF, by_key, requests, warehouse

KINDS = ["signup", "purchase", "view", "click", "error"]


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(9)
    # item 0 has most of the rows; ids are clustered
    rows = [(i if i < 80 else i + 5000, rnd.choice([0, 0, 0, 1, 2]), rnd.choice(KINDS), rnd.randint(1, 5000) / 100)
            for i in range(160)]
    return spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").cache()


def walk(events):
    balance, out = {}, {}
    for e in sorted(events.collect(), key=lambda r: r.event_id):
        kind = ledger.MOVEMENT_OF_EVENT.get(e.event_type)
        if kind is None:
            continue
        free, held = balance.get(e.user_id, (D(0), D(0)))
        qty = D(str(e.value)).quantize(D("0.01"))
        ok = kind == "receipt" or (free if kind == "reserve" else held) >= qty
        if ok:
            free += qty if kind in ("receipt", "release") else -qty if kind == "reserve" else 0
            held += qty if kind == "reserve" else 0 if kind == "receipt" else -qty
        balance[e.user_id] = (free, held)
        out[e.event_id] = (kind, ok, free, held)
    return out


FIELDS = ("kind", "accepted", "available_quantity", "reserved_quantity")


@pytest.mark.parametrize("rows_per_batch", [1000, 40])
def test_ledger_does_not_depend_on_the_batches(spark, events, rows_per_batch):
    got = stream_table(events.repartition(3), "event_id", lambda s: ledger.stock_ledger(ledger.movements(s)),
                       rows_per_batch=rows_per_batch)
    expected = walk(events)
    assert by_key(got, "event_id", *FIELDS) == expected
    assert all(free >= 0 and held >= 0 for _, _, free, held in expected.values())


def test_batches_are_bounded_and_in_order(spark, events):
    """One query reads all rows, rows without an order first, at most so many a micro-batch."""
    rows = events.unionByName(events.limit(3).selectExpr("CAST(NULL AS BIGINT) AS event_id", "user_id", "event_type",
                                                         "value")).repartition(5)
    seen = []
    query = (ordered_stream(rows, "event_id", 20).writeStream
             .foreachBatch(lambda df, n: seen.append([r.event_id for r in df.collect()]))
             .option("checkpointLocation", fresh_path(spark, "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    batches = [b for b in seen if b]
    assert len(batches) > 5 and max(map(len, batches)) <= 20
    flat = [[-1 if i is None else i for i in b] for b in batches]
    assert all(max(a) <= min(b) for a, b in zip(flat, flat[1:]))
    assert sorted(i for b in flat for i in b) == sorted([-1] * 3 + [r.event_id for r in events.collect()])
    nothing = stream_table(events.limit(0), "event_id", lambda s: ledger.stock_ledger(ledger.movements(s)))
    assert nothing.collect() == [] and nothing.columns[0] == "item_id"


def test_the_table_is_scanned_once(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "events"))
    plan = spark.read.parquet(str(tmp_path / "events")).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_ledger_goes_on_after_a_restart(spark, events):
    source, out, checkpoint = (fresh_path(spark, n) for n in ("source", "out", "checkpoint"))
    for part in ("event_id < 50", "event_id >= 50"):
        events.filter(part).write.mode("append").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(events.schema).parquet(source)
            run_to_end(ledger.stock_ledger(ledger.movements(stream)), out, checkpoint)
    assert by_key(spark.read.parquet(out), "event_id", *FIELDS) == walk(events)
    assert spark.read.parquet(out).count() == len(walk(events))


def test_transitions_stream_equals_batch(spark, events):
    batch = transitions.status_transitions(transitions.statuses(events), span=16)
    stream = transitions.transitions_stream(
        ordered_stream(transitions.statuses(events), "event_id", 30), fresh_path(spark, "statuses"),
        fresh_path(spark, "checkpoint"), span=16)
    assert sorted(batch.collect()) == sorted(stream.collect())
    firsts = {min(r.event_id for r in events.collect() if r.user_id == u) for u in (0, 1, 2)}
    assert not firsts & {r.event_id for r in batch.collect()}


def test_init_stock_stream_opens_an_item_once(spark, events):
    got = stream_table(events, "event_id", ledger.init_stock, rows_per_batch=60)
    assert sorted(r.item_id for r in got.collect()) == [0, 1, 2]


@pytest.fixture
def buying(spark):
    return warehouse(
        spark, items=[{}], stock_balance=[{"item_id": 1}], purchase_orders=[{}],
        purchase_order_lines=[{"po_id": 1, "item_id": 1, "ordered_quantity": 10}],
        goods_receipts=[{"po_id": 1}, {"po_id": 1}, {"po_id": 1}],
        goods_receipt_lines=[{"grn_id": g, "item_id": 1, "received_quantity": q}
                             for g, q in ((1, 4), (2, 7), (3, 6))])


def test_confirm_stream_applies_each_batch_once(spark, buying):
    root = fresh_path(spark, "store")
    store = SnapshotStore(spark, root)
    store.commit({t: buying[t] for t in ("goods_receipts", "goods_receipt_lines", "purchase_orders",
                                         "purchase_order_lines", "stock_balance")})
    asked = requests(spark, "req_seq long, grn_id long", [(1, 1), (2, 2), (3, 3)])
    confirm_stream(ordered_stream(asked, "req_seq", 1), root, fresh_path(spark, "checkpoint"), AS_OF)
    assert by_key(store.tables()["goods_receipts"], "grn_id", "status") == {
        1: "Confirmed", 2: "Draft", 3: "Confirmed"}
    assert by_key(store.tables()["stock_balance"], "item_id", "available_quantity") == {1: D(10)}

    # another stream numbers its batches from 0 again; its requests are applied, once
    def run(rows, source, checkpoint):
        requests(spark, "req_seq long, grn_id long", rows).write.mode("append").parquet(source)
        confirm_stream(spark.readStream.schema(asked.schema).parquet(source), root, checkpoint, AS_OF)

    version = store.commit({})
    source, checkpoint = fresh_path(spark, "again"), fresh_path(spark, "checkpoint")
    run([(1, 2)], source, checkpoint)
    assert store.commit({}) == version + 2
    run([], source, checkpoint)
    stock = by_key(store.tables()["stock_balance"], "item_id", "available_quantity")
    assert stock == {1: D(10)}


def test_a_second_stream_is_not_skipped(spark, buying):
    root = fresh_path(spark, "store")
    store = SnapshotStore(spark, root)
    store.commit({t: buying[t] for t in ("goods_receipts", "goods_receipt_lines", "purchase_orders",
                                         "purchase_order_lines", "stock_balance")})
    for grn in (1, 3):
        source = fresh_path(spark, "source")
        asked = requests(spark, "req_seq long, grn_id long", [(1, grn)])
        asked.write.parquet(source)
        confirm_stream(spark.readStream.schema(asked.schema).parquet(source), root,
                       fresh_path(spark, "checkpoint"), AS_OF)
    assert by_key(store.tables()["goods_receipts"], "grn_id", "status") == {
        1: "Confirmed", 2: "Draft", 3: "Confirmed"}


def test_unknown_statuses_change_nothing_in_stream_and_batch(spark):
    source = fresh_path(spark, "log")
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, "c"), (2, 1, None)],
                                "document long, event_id long, status string")
    log.write.parquet(source)
    batch = transitions.status_transitions(log).collect()
    assert [(r.event_id, r.old_status, r.new_status) for r in batch] == [(4, "b", "c")]


def test_transitions_with_unknown_statuses_over_batches_and_a_restart(spark):
    """A document whose rows lie in many batches, with statuses that are NULL at the seams."""
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i, rnd.choice(["a", "b", "c", None])) for i in range(-40, 60)]
    kind = "document long, event_id long, status string"
    log = spark.createDataFrame(rows, kind)
    want = sorted(transitions.status_transitions(log).collect())
    root, checkpoint, source = (fresh_path(spark, n) for n in ("statuses", "checkpoint", "source"))
    got = transitions.transitions_stream(ordered_stream(log, "event_id", 9), fresh_path(spark, "s"), checkpoint, span=4)
    assert sorted(got.collect()) == want and len(want) > 20
    checkpoint = fresh_path(spark, "checkpoint")
    for part in ("event_id < 7", "event_id >= 7"):
        log.filter(part).write.mode("append").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            got = transitions.transitions_stream(spark.readStream.schema(log.schema).parquet(source), root, checkpoint)
    assert sorted(spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/_found").collect()) == want


def test_confirm_stream_equals_one_batch(spark, buying):
    asked = requests(spark, "req_seq long, grn_id long", [(1, 1), (2, 2), (3, 3)])
    whole = confirm_grn(buying, asked, AS_OF)
    assert {r.grn_id: r.outcome for r in whole.outcome.collect()} == {
        1: "accepted", 2: "rejected", 3: "accepted"}
