"""Document jobs: rules, odd cases, and batches against one request after the other."""

import random
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from depotflow.plans import masters, procurement, sales
from depotflow.plans.jobs import stamp_changes
from tests.small import AS_OF, NOW, T0, by_key, outcomes, requests, table, warehouse

ITEMS = [{} for _ in range(4)]


def stock(*rows):
    return [{"item_id": i, "available_quantity": a, "reserved_quantity": r} for i, a, r in rows]


# -- receipts ---------------------------------------------------------------------


def test_many_receipts_per_order_equal_one_by_one(spark):
    rnd = random.Random(1)
    orders = range(1, 5)
    ordered = {(po, i): rnd.randint(5, 40) for po in orders for i in range(1, 4) if (po, i) != (4, 2)}
    grns = {g: rnd.choice(orders) for g in range(1, 25)}
    lines = [(g, i, rnd.randint(1, 14)) for g in grns for i in rnd.sample(range(1, 4), rnd.randint(0, 3))]
    w = warehouse(
        spark, items=ITEMS, stock_balance=stock((1, 5, 0), (2, 0, 0), (3, 0, 0)),
        purchase_orders=[{} for _ in orders],
        purchase_order_lines=[{"po_id": po, "item_id": i, "ordered_quantity": q}
                              for (po, i), q in ordered.items()],
        goods_receipts=[{"po_id": po} for po in grns.values()],
        goods_receipt_lines=[{"grn_id": g, "item_id": i, "received_quantity": q} for g, i, q in lines])
    asked = rnd.sample(list(grns), len(grns)) + [1, 2]
    rows = list(enumerate(asked, 100))

    received, available = dict.fromkeys(ordered, 0), {1: 5, 2: 0, 3: 0}
    confirmed, expected, touched = set(), {}, set()
    for seq, g in rows:
        mine = [(i, q) for g2, i, q in lines if g2 == g]
        if g in confirmed:
            expected[seq] = "unchanged"
        elif any((grns[g], i) in ordered and received[grns[g], i] + q > ordered[grns[g], i]
                 for i, q in mine):
            expected[seq] = "rejected"
        else:
            expected[seq] = "accepted"
            confirmed.add(g)
            touched.add(grns[g])
            for i, q in mine:
                available[i] += q
                if (grns[g], i) in ordered:
                    received[grns[g], i] += q

    result = procurement.confirm_grn(w, requests(spark, "req_seq long, grn_id long", rows), AS_OF, span=32)
    assert outcomes(result, "outcome") == expected
    assert {"accepted", "rejected", "unchanged"} <= set(expected.values())
    assert by_key(result.changed["stock_balance"], "item_id", "available_quantity") == available
    got = {(r.po_id, r.item_id): r.received_quantity
           for r in result.changed["purchase_order_lines"].collect()}
    assert got == received
    status = {
        po: "Pending" if po not in touched
        else "Completed" if all(received[k] == ordered[k] for k in ordered if k[0] == po)
        else "Partially_Received" for po in orders}
    assert by_key(result.changed["purchase_orders"], "po_id", "status") == status


def test_a_receipt_asked_again_fails_on_the_line_of_its_turn(spark):
    w = warehouse(
        spark, items=ITEMS, stock_balance=stock((1, 0, 0), (2, 0, 0)), purchase_orders=[{}],
        purchase_order_lines=[{"po_id": 1, "item_id": 1, "ordered_quantity": 10},
                              {"po_id": 1, "item_id": 2, "ordered_quantity": 5}],
        goods_receipts=[{"po_id": 1}, {"po_id": 1}],
        goods_receipt_lines=[{"grn_id": 1, "item_id": 1, "received_quantity": 4},
                             {"grn_id": 1, "item_id": 2, "received_quantity": 6},
                             {"grn_id": 2, "item_id": 1, "received_quantity": 8}])
    rows = [(1, 1), (2, 2), (3, 1), (4, 2)]
    result = procurement.confirm_grn(w, requests(spark, "req_seq long, grn_id long", rows), AS_OF)
    text = "GRN exceeds PO quantity for item_id"
    assert outcomes(result, "outcome", "reason") == {
        1: ("rejected", f"{text} 2"), 2: ("accepted", None), 3: ("rejected", f"{text} 1"), 4: ("unchanged", None)}


def test_given_line_ids_are_taken_once(spark):
    rnd = random.Random(8)
    w = warehouse(spark, items=ITEMS, purchase_orders=[{}, {}], purchase_order_lines=[
        {"po_line_id": 7, "po_id": 1, "item_id": 1, "ordered_quantity": 1}])
    rows = [(s, rnd.choice([1, 2]), rnd.randint(1, 4), rnd.choice([1, 1, 2, 3, 4, 5, 7, None]), rnd.choice([1, 2, 0]))
            for s in range(60)]
    result = procurement.add_lines(w, "purchase_order_lines", requests(
        spark, "req_seq long, po_id long, item_id long, po_line_id long, quantity int", rows))
    ids, pairs, expected = {7}, {(1, 1)}, {}
    for s, po, item, key, q in rows:
        if key is None:
            expected[s] = "not_null po_line_id"
        elif not q:
            expected[s] = "check_range ordered_quantity"
        elif (po, item) == (1, 1):
            expected[s] = "duplicate po_id, item_id"
        elif key in ids:
            expected[s] = "primary_key po_line_id"
        elif (po, item) in pairs:
            expected[s] = "duplicate po_id, item_id"
        else:
            expected[s] = None
            ids.add(key), pairs.add((po, item))
    assert outcomes(result, "reason") == expected
    got = [r.po_line_id for r in result.changed["purchase_order_lines"].collect()]
    assert sorted(got) == sorted(ids)


def test_given_challan_ids_are_taken_once(spark):
    w = warehouse(spark, sales_orders=[{"status": "Packed"}, {"status": "Packed"}, {}],
                  delivery_challans=[{"so_id": 1, "dc_id": 5}])
    rows = [(1, 1, 1, 5), (2, 3, 1, 9), (3, 2, 1, 9), (4, 1, 1, 9), (5, 1, 1, None), (6, 1, 1, 6)]
    result = sales.create_dc(w, requests(spark, "req_seq long, so_id long, created_by long, dc_id long", rows), AS_OF)
    assert outcomes(result, "dc_id", "reason") == {
        1: (None, "primary_key dc_id"), 2: (None, "SO 3 must be Packed before creating a DC. Current status: Pending."),
        3: (9, None), 4: (None, "primary_key dc_id"), 5: (None, "not_null dc_id"), 6: (6, None)}
    assert sorted(r.dc_id for r in result.changed["delivery_challans"].collect()) == [5, 6, 9]


def test_receipt_odd_cases(spark):
    w = warehouse(
        spark, items=ITEMS, stock_balance=stock((1, 0, 0), (2, 0, 0)),
        purchase_orders=[{}, {"status": "Cancelled"}, {}],
        purchase_order_lines=[{"po_id": 1, "item_id": 1, "ordered_quantity": 5},
                              {"po_id": 2, "item_id": 1, "ordered_quantity": 5}],
        goods_receipts=[{"po_id": 1}, {"po_id": 2}, {"po_id": 3}, {"po_id": 1, "status": "Confirmed"}],
        goods_receipt_lines=[{"grn_id": 1, "item_id": 2, "received_quantity": 7},
                             {"grn_id": 2, "item_id": 1, "received_quantity": 5}])
    rows = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 99)]
    result = procurement.confirm_grn(w, requests(spark, "req_seq long, grn_id long", rows), AS_OF)
    # item 2 is not on order 1: not limited, stock rises, and the receipt is flagged
    assert outcomes(result, "outcome", "unmatched") == {
        1: ("accepted", True), 2: ("accepted", False), 3: ("accepted", False),
        4: ("unchanged", False), 5: ("unchanged", False)}
    assert by_key(result.changed["stock_balance"], "item_id", "available_quantity") == {1: D(5), 2: D(7)}
    # even a cancelled order gets a new status; an order without lines counts as open
    assert by_key(result.changed["purchase_orders"], "po_id", "status", "received_at", "updated_at") == {
        1: ("Partially_Received", None, NOW), 2: ("Completed", NOW, NOW),
        3: ("Partially_Received", None, NOW)}


def test_cancel_po(spark):
    w = warehouse(spark, purchase_orders=[{}, {"status": "Completed"}, {}])
    rows = [(1, 1), (2, 1), (3, 2), (4, 9)]
    result = procurement.cancel_po(w, requests(spark, "req_seq long, po_id long", rows), AS_OF)
    tail = "cannot be cancelled. Only Pending POs can be cancelled. Current status:"
    assert outcomes(result, "outcome", "reason") == {
        1: ("accepted", None), 2: ("rejected", f"PO 1 {tail} Cancelled."),
        3: ("rejected", f"PO 2 {tail} Completed."), 4: ("rejected", "Purchase Order 9 not found.")}
    assert by_key(result.changed["purchase_orders"], "po_id", "status", "updated_at") == {
        1: ("Cancelled", NOW), 2: ("Completed", T0), 3: ("Pending", T0)}


# -- challans ---------------------------------------------------------------------


def test_many_challans_with_short_reserved_stock_equal_one_by_one(spark):
    rnd = random.Random(3)
    orders = range(1, 6)
    ordered = {(so, i): rnd.randint(5, 30) for so in orders for i in range(1, 4)}
    dcs = {d: rnd.choice(orders) for d in range(1, 25)}
    lines = [(d, i, rnd.randint(1, 12)) for d in dcs for i in rnd.sample(range(1, 4), rnd.randint(0, 3))]
    held = {1: 45, 2: 30, 3: 1000}  # less is reserved of items 1 and 2 than is ordered
    w = warehouse(
        spark, items=ITEMS, stock_balance=stock(*[(i, 0, q) for i, q in held.items()]),
        sales_orders=[{"status": "Packed"} for _ in orders],
        sales_order_lines=[{"so_id": so, "item_id": i, "ordered_quantity": q}
                           for (so, i), q in ordered.items()],
        delivery_challans=[{"so_id": so} for so in dcs.values()],
        delivery_challan_lines=[{"dc_id": d, "item_id": i, "shipped_quantity": q} for d, i, q in lines])
    rows = list(enumerate(rnd.sample(list(dcs), len(dcs)), 7))

    shipped, reserved, expected, touched = dict.fromkeys(ordered, 0), dict(held), {}, set()
    for seq, d in rows:
        mine = [(i, q) for d2, i, q in lines if d2 == d]
        so = dcs[d]
        if any(shipped[so, i] + q > ordered[so, i] or q > reserved[i] for i, q in mine):
            expected[seq] = "rejected"
            continue
        expected[seq] = "accepted"
        touched.add(so)
        for i, q in mine:
            shipped[so, i] += q
            reserved[i] -= q

    result = sales.dispatch_dc(w, requests(spark, "req_seq long, dc_id long", rows), AS_OF, span=16)
    assert outcomes(result, "outcome") == expected
    reasons = {r[:9] for r in outcomes(result, "reason").values() if r}
    assert reasons == {"Shipment ", "reserved "}
    assert by_key(result.changed["stock_balance"], "item_id", "reserved_quantity") == reserved
    assert {(r.so_id, r.item_id): r.shipped_quantity
            for r in result.changed["sales_order_lines"].collect()} == shipped
    assert by_key(result.changed["sales_orders"], "so_id", "status") == {
        so: "Packed" if so not in touched
        else "Shipped" if all(shipped[k] == ordered[k] for k in ordered if k[0] == so)
        else "Processing" for so in orders}


def test_challan_odd_cases(spark):
    w = warehouse(
        spark, items=ITEMS, stock_balance=stock((1, 0, 10), (2, 0, 10)),
        sales_orders=[{"status": "Packed"}, {"status": "Shipped"}, {"status": "Packed"}],
        sales_order_lines=[{"so_id": 1, "item_id": 1, "ordered_quantity": 4},
                           {"so_id": 2, "item_id": 1, "ordered_quantity": 4, "shipped_quantity": 4}],
        delivery_challans=[{"so_id": 1}, {"so_id": 2, "status": "Delivered"}, {"so_id": 3},
                           {"so_id": 2, "status": "Dispatched"}],
        delivery_challan_lines=[{"dc_id": 1, "item_id": 2, "shipped_quantity": 3},
                                {"dc_id": 2, "item_id": 1, "shipped_quantity": 1}])
    rows = [(1, 1), (2, 2), (3, 3), (4, 4)]
    result = sales.dispatch_dc(w, requests(spark, "req_seq long, dc_id long", rows), AS_OF)
    # a delivered challan is evaluated again; an item that is not ordered is not limited
    assert outcomes(result, "outcome", "unmatched", "was_delivered") == {
        1: ("accepted", True, False), 2: ("rejected", False, True),
        3: ("accepted", False, False), 4: ("unchanged", False, False)}
    # an order without lines has nothing that proves it complete
    assert by_key(result.changed["sales_orders"], "so_id", "status") == {
        1: "Processing", 2: "Shipped", 3: "Processing"}
    assert by_key(result.changed["delivery_challans"], "dc_id", "status", "dispatched_at") == {
        1: ("Dispatched", NOW), 2: ("Delivered", None), 3: ("Dispatched", NOW),
        4: ("Dispatched", None)}


def test_deliver(spark):
    w = warehouse(
        spark, items=ITEMS,
        sales_orders=[{"status": "Shipped"}, {"status": "Processing"}, {"status": "Packed"}],
        sales_order_lines=[
            {"so_id": 1, "item_id": 1, "ordered_quantity": 4, "shipped_quantity": 4},
            {"so_id": 2, "item_id": 1, "ordered_quantity": 4, "shipped_quantity": 1}],
        delivery_challans=[{"so_id": 1, "status": "Dispatched"}, {"so_id": 2, "status": "Pending"},
                           {"so_id": 3, "status": "Failed"}, {"so_id": 1, "status": "Delivered"}])
    rows = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]
    result = sales.deliver_dc(w, requests(spark, "req_seq long, dc_id long", rows), AS_OF)
    assert outcomes(result, "outcome", "not_dispatched") == {
        1: ("accepted", False), 2: ("accepted", True), 3: ("accepted", True),
        4: ("unchanged", False), 5: ("unchanged", False)}
    assert by_key(result.changed["sales_orders"], "so_id", "status", "updated_at") == {
        1: ("Delivered", NOW), 2: ("Processing", T0), 3: ("Packed", T0)}


def test_create_dc(spark):
    w = warehouse(spark, sales_orders=[{"status": "Packed"}, {}, {"status": "Packed"}])
    rows = [(1, 1, 1), (2, 2, 1), (3, 9, 1), (4, 3, 1), (5, 3, 77)]
    asked = requests(spark, "req_seq long, so_id long, created_by long", rows)
    result = sales.create_dc(w, asked, AS_OF)
    assert outcomes(result, "dc_id", "reason") == {
        1: (1, None), 4: (2, None), 3: (None, "Sales Order 9 not found."),
        2: (None, "SO 2 must be Packed before creating a DC. Current status: Pending."),
        5: (None, "foreign_key created_by")}
    made = result.changed["delivery_challans"].collect()
    assert {(r.driver_name, r.vehicle_number, r.status) for r in made} == {("", "", "Pending")}


# -- sales orders -----------------------------------------------------------------


def test_reserve_rules(spark):
    w = warehouse(
        spark, items=ITEMS, stock_balance=stock((1, 10, 0), (2, 5, 0)),
        sales_orders=[{}, {"status": "Delivered"}],
        sales_order_lines=[{"so_id": 1, "item_id": 2, "ordered_quantity": 1}])
    rows = [
        (1, 1, 1, "20"),      # too much
        (2, 1, 1, "6.005"),   # the same pair again: the first took nothing; rounds to 6.01
        (3, 1, 1, "1"),       # the pair is taken now
        (4, 2, 1, "3.99"),    # a closed order may still reserve
        (5, 1, 2, "1"),       # already a line of the order
        (6, 2, 2, "0"), (7, 2, 2, None), (8, 7, 2, "1"), (9, 2, 9, "1"),
        (10, 1, 3, "50"),     # no stock row: accepted, nothing moves
    ]
    asked = requests(spark, "req_seq long, so_id long, item_id long, quantity string", rows).selectExpr(
        "req_seq", "so_id", "item_id", "CAST(quantity AS DECIMAL(20,3)) AS quantity")
    result = sales.reserve_stock(w, asked, AS_OF)
    assert outcomes(result, "reason", "no_stock_row") == {
        1: ("Insufficient stock for item_id 1. Available: 10.00, Requested: 20.00", False),
        2: (None, False), 3: ("duplicate so_id, item_id", False), 4: (None, False),
        5: ("duplicate so_id, item_id", False),
        6: ("check_range ordered_quantity", False), 7: ("not_null ordered_quantity", False),
        8: ("foreign_key so_id", False), 9: ("foreign_key item_id", False), 10: (None, True)}
    assert by_key(result.changed["stock_balance"], "item_id", "available_quantity",
                  "reserved_quantity", "last_updated") == {
        1: (D("0.00"), D("10.00"), NOW), 2: (D("5.00"), D("0.00"), T0)}
    assert result.changed["sales_order_lines"].count() == 4


def test_advance_steps(spark):
    w = warehouse(spark, sales_orders=[{}, {"status": "Processing"}, {"status": "Packed"}])
    rows = [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 9)]
    result = sales.advance_so(w, requests(spark, "req_seq long, so_id long", rows), AS_OF)
    assert outcomes(result, "new_status") == {
        1: "Processing", 2: "Packed", 3: None, 4: "Packed", 5: None, 6: None, 7: None}
    assert outcomes(result, "reason")[3] == (
        'SO 1 cannot be advanced from status "Packed". '
        "Only Pending and Processing can be manually advanced.")
    assert by_key(result.changed["sales_orders"], "so_id", "status", "updated_at") == {
        1: ("Packed", NOW), 2: ("Packed", NOW), 3: ("Packed", T0)}


def test_advance_filters_ranks_before_the_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.partitionBy("so_id").orderBy("req_seq")
    df = spark.range(100).selectExpr("id % 3 AS so_id", "id AS req_seq").withColumn(
        "step", F.row_number().over(order)).filter("step <= 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cancel_so_releases_and_checks_reserved(spark):
    w = warehouse(
        spark, items=ITEMS, stock_balance=stock((1, 1, 10), (2, 0, 1)),
        sales_orders=[{}, {"status": "Shipped"}, {"status": "Processing"}, {}],
        sales_order_lines=[
            {"so_id": 1, "item_id": 1, "ordered_quantity": 8, "shipped_quantity": 2},
            {"so_id": 3, "item_id": 1, "ordered_quantity": 5},
            {"so_id": 4, "item_id": 1, "ordered_quantity": 4},
            {"so_id": 4, "item_id": 3, "ordered_quantity": 9}])
    rows = [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 9)]
    result = sales.cancel_so(w, requests(spark, "req_seq long, so_id long", rows), AS_OF)
    assert outcomes(result, "outcome", "reason") == {
        1: ("accepted", None),
        2: ("rejected", "SO 1 cannot be cancelled. Current status: Cancelled."),
        3: ("rejected", "SO 2 cannot be cancelled. Current status: Shipped."),
        # 6 of 10 are released by then, 5 more do not fit, 4 do
        4: ("rejected", "reserved quantity of item_id 1 would fall below zero"),
        5: ("accepted", None), 6: ("rejected", "Sales Order 9 not found.")}
    assert by_key(result.changed["stock_balance"], "item_id", "available_quantity",
                  "reserved_quantity") == {1: (D(11), D(0)), 2: (D(0), D(1))}
    assert by_key(result.changed["sales_orders"], "so_id", "status") == {
        1: "Cancelled", 2: "Shipped", 3: "Processing", 4: "Cancelled"}


# -- headers, lines, master data --------------------------------------------------


def test_create_documents_and_lines(spark):
    w = warehouse(spark, items=ITEMS, purchase_orders=[{"po_id": 4}])
    made = procurement.create_documents(
        w, "purchase_orders", requests(
            spark, "req_seq long, supplier_id long, created_by long",
            [(5, 1, 1), (3, 1, 1), (4, 8, 1), (6, None, 1)]), AS_OF)
    assert outcomes(made, "po_id", "reason") == {
        3: (5, None), 5: (6, None), 4: (None, "foreign_key supplier_id"),
        6: (None, "not_null supplier_id")}
    after = made.applied_to(w)
    row = after["purchase_orders"].filter("po_id = 5").head()
    assert (row.status, row.notes, row.created_at, row.received_at) == ("Pending", None, NOW, None)

    rows = [(1, 5, 1, "2"), (2, 5, 1, "3"), (3, 5, 2, "0"), (4, 5, 2, "1.005"), (5, 5, 99, "1")]
    asked = requests(spark, "req_seq long, po_id long, item_id long, quantity string", rows).selectExpr(
        "req_seq", "po_id", "item_id", "CAST(quantity AS DECIMAL(20,3)) AS quantity")
    result = procurement.add_lines(after, "purchase_order_lines", asked)
    assert outcomes(result, "reason") == {
        1: None, 2: "duplicate po_id, item_id", 3: "check_range ordered_quantity", 4: None,
        5: "foreign_key item_id"}
    got = result.changed["purchase_order_lines"].orderBy("po_line_id").collect()
    assert [(r.po_line_id, r.ordered_quantity, r.pending_quantity, r.unit_cost) for r in got] == [
        (1, D("2.00"), D("2.00"), D(0)), (2, D("1.01"), D("1.01"), D(0))]


def test_ids_given_by_the_caller(spark):
    w = warehouse(spark, purchase_orders=[{}])
    made = procurement.create_documents(
        w, "goods_receipts", requests(
            spark, "req_seq long, grn_id long, po_id long, received_by long", [(1, 70, 1, 1)]), AS_OF)
    assert outcomes(made, "grn_id") == {1: 70}
    assert by_key(made.changed["goods_receipts"], "grn_id", "status") == {70: "Draft"}


def test_init_stock_is_idempotent(spark):
    w = warehouse(spark, items=ITEMS, stock_balance=stock((2, 7, 1)))
    once = masters.init_stock(w, w["items"], AS_OF)
    twice = masters.init_stock({**w, "stock_balance": once}, w["items"], AS_OF)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert by_key(twice, "item_id", "available_quantity") == {1: D(0), 2: D(7), 3: D(0), 4: D(0)}


def test_upsert_overwrites_all_fields(spark):
    w = warehouse(spark, suppliers=[{"email": "a@x", "phone": "1"}, {"email": "b@x"}])
    rows = [(1, 1, "new", None), (2, 1, "newer", "2"), (3, 2, None, "3"), (4, 9, None, "4"),
            (5, None, "third", "5"), (6, None, "", "6")]
    result = masters.upsert_master(
        w, "suppliers", requests(spark, "req_seq long, supplier_id long, supplier_name string, "
                                        "phone string", rows), AS_OF)
    assert outcomes(result, "supplier_id", "outcome", "reason") == {
        1: (1, "accepted", None), 2: (1, "accepted", None),
        3: (2, "rejected", "not_null supplier_name"), 4: (9, "unchanged", None),
        5: (3, "accepted", None), 6: (None, "rejected", "required field is empty")}
    # the e-mail address was not given, so it is gone
    assert by_key(result.changed["suppliers"], "supplier_id", "supplier_name", "email", "phone") == {
        1: ("newer", None, "2"), 2: ("s 2", "b@x", None), 3: ("third", None, "5")}


def test_upsert_items_default_is_for_absent_fields_only(spark):
    w = warehouse(spark, items=[{"reorder_level": 5}], stock_balance=stock((1, 1, 0)))
    absent = requests(spark, "req_seq long, item_id long, item_name string, uom_id long",
                      [(1, 1, "renamed", 1), (2, None, "made", 1)])
    result = masters.upsert_master(w, "items", absent, AS_OF)
    assert by_key(result.changed["items"], "item_id", "item_name", "reorder_level") == {
        1: ("renamed", D(0)), 2: ("made", D(0))}
    assert by_key(result.changed["stock_balance"], "item_id", "available_quantity") == {1: D(1), 2: D(0)}
    null = absent.selectExpr("*", "CAST(NULL AS DECIMAL(12,2)) AS reorder_level")
    assert set(outcomes(masters.upsert_master(w, "items", null, AS_OF), "reason").values()) == {
        "not_null reorder_level"}


def test_deactivate_and_stamp(spark):
    w = warehouse(spark, users=[{}, {}], items=ITEMS, stock_balance=stock((1, 1, 0), (2, 1, 0)))
    off = masters.deactivate(w, "users", requests(spark, "user_id long", [(2,), (9,), (2,)]))
    assert by_key(off, "user_id", "is_active") == {1: True, 2: False}
    stamped = stamp_changes(w["stock_balance"], requests(spark, "item_id long", [(1,)]),
                            "item_id", "last_updated", AS_OF)
    assert by_key(stamped, "item_id", "last_updated") == {1: NOW, 2: T0}


def test_assign_roles(spark):
    w = warehouse(spark, users=[{"username": "ann"}], roles=[{"role_name": "Clerk"}])
    rows = [(1, "bob", "Clerk"), (2, "bob", "Clerk"), (3, "ann", "Clerk"), (4, "cy", "Boss"),
            (5, "", "Clerk"), (6, "dee", None)]
    result = masters.assign_roles(
        w, requests(spark, "req_seq long, username string, role string", rows), AS_OF)
    assert outcomes(result, "user_id", "reason") == {
        1: (2, None), 2: (None, "duplicate username"), 3: (None, "duplicate username"),
        4: (None, "Role 'Boss' does not exist"), 5: (None, "required field is empty"),
        6: (None, "required field is empty")}
    assert [tuple(r) for r in result.changed["user_roles"].collect()] == [(2, 1)]


@pytest.mark.parametrize("name", ["suppliers", "items"])
def test_table_helper_follows_the_model(spark, name):
    from depotflow.schemas import MODEL

    assert table(spark, name, [{}]).columns == MODEL[name].names


def test_given_ids_that_are_taken_are_refused(spark, star):
    rows = [(1, 1, 1), (2, 900001, 1), (3, 900001, 1), (4, None, 1)]
    taken = star["sales_orders"].agg({"so_id": "min"}).first()[0]
    rows[0] = (1, taken, 1)
    asked = spark.createDataFrame(rows, "req_seq long, so_id long, customer_id long").withColumn(
        "created_by", F.lit(1).cast("bigint"))
    result = procurement.create_documents(star, "sales_orders", asked, AS_OF)
    got = {r.req_seq: (r.outcome, r.reason) for r in result.outcome.collect()}
    assert got == {1: ("rejected", "primary_key so_id"), 2: ("accepted", None),
                   3: ("rejected", "primary_key so_id"), 4: ("rejected", "not_null so_id")}
    assert result.changed["sales_orders"].filter("so_id = 900001").count() == 1


def test_lines_are_not_stored_again_to_find_the_first_of_a_pair(spark, monkeypatch):
    w = warehouse(spark, items=ITEMS, purchase_orders=[{}, {}], purchase_order_lines=[
        {"po_id": 1, "item_id": 1, "ordered_quantity": 1}])
    rows = [(1, 1, 1, 5), (2, 2, 1, 0), (3, 2, 1, 5), (4, 2, 1, 6), (5, 9, 1, 5)]
    monkeypatch.setattr(procurement, "durable", lambda df: pytest.fail("stored again"))
    result = procurement.add_lines(w, "purchase_order_lines", requests(
        spark, "req_seq long, po_id long, item_id long, quantity int", rows))
    assert outcomes(result, "reason") == {
        1: "duplicate po_id, item_id", 2: "check_range ordered_quantity", 3: None, 4: "duplicate po_id, item_id",
        5: "foreign_key po_id"}


def test_advanced_orders_need_no_rank(spark, monkeypatch):
    w = warehouse(spark, sales_orders=[{}, {"status": "Processing"}])
    rows = [(s, so) for s, so in enumerate([1, 1, 1, 2, 9])]
    monkeypatch.setattr(sales, "durable", lambda df: pytest.fail("requests are ranked and stored"))
    changed = sales.advance_so(w, requests(spark, "req_seq long, so_id long", rows), AS_OF).changed["sales_orders"]
    assert [r.status for r in changed.orderBy("so_id").collect()] == ["Packed", "Packed"]
