"""Each rule finds the rows planted for it."""

from decimal import Decimal as D

from depotflow.operators import quality
from tests.small import requests, table, warehouse


def fields(report):
    return sorted((r.field, r.row_key) for r in report.collect())


def test_not_null_range_domain_and_length(spark):
    rows = spark.sql("""SELECT * FROM VALUES
        (1L, 'ok', 1.00BD, 1L, true, timestamp_ntz'2026-01-01 00:00:00'),
        (2L, NULL, -1.00BD, NULL, true, timestamp_ntz'2026-01-01 00:00:00'),
        (3L, repeat('é', 201), NULL, 1L, NULL, NULL),
        (4L, repeat('é', 200), 0.00BD, 1L, true, timestamp_ntz'2026-01-01 00:00:00')
        AS t(item_id, item_name, reorder_level, uom_id, is_active, created_at)""")
    assert fields(quality.not_null(rows, "items")) == [
        ("created_at", "3"), ("is_active", "3"), ("item_name", "2"), ("reorder_level", "3"),
        ("uom_id", "2")]
    assert fields(quality.check_range(rows, "items")) == [("reorder_level", "2")]  # NULL passes
    assert fields(quality.varchar_length(rows, "items")) == [("item_name", "3")]
    accepted, rejected = quality.split(rows, "items")
    assert sorted(r.item_id for r in accepted.collect()) == [1, 4]
    assert {r.item_id: r.reject_reason for r in rejected.collect()} == {
        2: "not_null item_name", 3: "not_null reorder_level"}


def test_status_domain(spark):
    rows = requests(spark, "so_id long, status string, payment_status string",
                    [(1, "Pending", "Paid"), (2, "pending", "Owed"), (3, None, None)])
    assert fields(quality.status_domain(rows, "sales_orders")) == [
        ("payment_status", "2"), ("status", "2")]


def test_unique_key_lets_nulls_through(spark):
    rows = requests(spark, "so_line_id long, so_id long, item_id long",
                    [(1, 1, 1), (2, 1, 1), (2, 1, 2), (4, None, 5), (5, None, 5)])
    got = sorted((r.field, r.row_key, r.rows) for r in
                 quality.unique_key(rows, "sales_order_lines").collect())
    assert got == [("so_id,item_id", "1|1", 2), ("so_line_id", "2", 2)]


def test_foreign_key(spark):
    w = warehouse(spark)
    rows = requests(spark, "so_id long, customer_id long, created_by long",
                    [(1, 1, 1), (2, 7, 1), (3, None, 9)])
    assert fields(quality.foreign_key(w, rows, "sales_orders")) == [
        ("created_by", "3"), ("customer_id", "2")]


def test_cascade_delete(spark):
    w = warehouse(
        spark, items=[{}], sales_orders=[{}, {}, {}],
        sales_order_lines=[{"so_id": so, "item_id": 1, "ordered_quantity": 1} for so in (1, 2, 3)],
        delivery_challans=[{"so_id": 2}])
    keys = requests(spark, "so_id long", [(1,), (2,), (8,), (1,)])
    changed, outcome = quality.cascade_delete(w, "sales_orders", keys)
    assert {r.so_id: (r.outcome, r.blocked_by) for r in outcome.collect()} == {
        1: ("deleted", None), 2: ("blocked", "delivery_challans"), 8: ("not_found", None)}
    assert sorted(r.so_id for r in changed["sales_orders"].collect()) == [2, 3]
    assert sorted(r.so_id for r in changed["sales_order_lines"].collect()) == [2, 3]


def test_cascade_delete_of_a_user(spark):
    w = warehouse(spark, users=[{}, {}], roles=[{}], purchase_orders=[{"created_by": 1}],
                  user_roles=[{"user_id": 1, "role_id": 1}, {"user_id": 2, "role_id": 1}])
    changed, outcome = quality.cascade_delete(w, "users", requests(spark, "user_id long", [(1,), (2,)]))
    assert {r.user_id: r.blocked_by for r in outcome.collect()} == {1: "purchase_orders", 2: None}
    assert [tuple(r) for r in changed["user_roles"].collect()] == [(1, 1)]


def test_required_fields_are_falsy_by_type(spark):
    rows = requests(spark, "request long, item_name string, uom_id long",
                    [(1, "a", 1), (2, "", 0), (3, None, None)])
    got = sorted(tuple(r) for r in quality.required_fields(rows, "create_item", "request").collect())
    assert got == [(2, "item_name"), (2, "uom_id"), (3, "item_name"), (3, "uom_id")]
    absent = quality.required_fields(rows.select("request"), "create_customer", "request")
    assert absent.count() == 3


def test_generated_columns_and_overflow(spark):
    rows = spark.sql("""SELECT * FROM VALUES
        (1L, 1L, 1L, 3.00BD, 1.00BD, 2.50BD), (2L, 1L, 2L, 9999999999.99BD, 0.00BD, 101.00BD),
        (3L, 1L, 3L, 9999999999.99BD, -1.00BD, 1.00BD)
        AS t(po_line_id, po_id, item_id, ordered_quantity, received_quantity, unit_cost)""").selectExpr(
        "po_line_id", "po_id", "item_id", "CAST(ordered_quantity AS DECIMAL(12,2)) ordered_quantity",
        "CAST(received_quantity AS DECIMAL(12,2)) received_quantity",
        "CAST(unit_cost AS DECIMAL(12,2)) unit_cost")
    sound, overflow = quality.generated_columns(rows, "purchase_order_lines")
    assert [(r.pending_quantity, r.line_total) for r in sound.collect()] == [(D("2.00"), D("7.50"))]
    assert sorted(r.po_line_id for r in overflow.collect()) == [2, 3]


def test_every_reference_names_a_table_with_one_key():
    from depotflow.schemas import MODEL

    references = [r for t in MODEL.values() for r in t.references]
    assert len(references) == 20
    assert sum(r.cascade for r in references) == 6
    assert all(len(MODEL[r.parent].key) == 1 for r in references)


def test_model_helper(spark):
    assert table(spark, "user_roles", [{"user_id": 1, "role_id": 2}]).head() == (1, 2)
