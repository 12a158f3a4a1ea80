"""Lists, lookups, views and column expressions."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from depotflow.functions import columns as C
from depotflow.functions.messages import PO_UNKNOWN, message
from depotflow.plans import lists, views
from tests.small import AS_OF, NOW, by_key, requests, warehouse


def test_user_without_roles_has_a_list_with_null(spark):
    w = warehouse(spark, users=[{}, {}], roles=[{"role_name": "b"}, {"role_name": "a"}],
                  user_roles=[{"user_id": 1, "role_id": 1}, {"user_id": 1, "role_id": 2}])
    assert by_key(lists.user_roles(w), "user_id", "roles") == {1: ["a", "b"], 2: [None]}
    assert by_key(lists.user_primary_role(w), "user_id", "role_name") == {1: "b"}


def test_lookup_hits_and_misses(spark):
    w = warehouse(spark, items=[{}], sales_orders=[{}, {}],
                  sales_order_lines=[{"so_id": 1, "item_id": 1, "ordered_quantity": 1}])
    keys = requests(spark, "so_id long", [(1,), (2,), (3,), (3,)])
    got = lists.lookup_by_keys(views.sales_order_full(w), keys, "so_id")
    # an order without lines has no detail rows, so it counts as missing
    assert sorted((r.so_id, r.found) for r in got.collect()) == [(1, True), (2, False), (3, False)]


def test_latest_key_of_an_empty_table(spark):
    w = warehouse(spark, purchase_orders=[{"po_id": 9}])
    assert by_key(lists.latest_keys(w), "document", "latest_id") == {
        "purchase_orders": 9, "goods_receipts": None, "sales_orders": None, "delivery_challans": None}


def test_unknown_role_is_reported(spark):
    w = warehouse(spark, roles=[{"role_name": "Clerk"}])
    got = lists.role_id_by_name(w, requests(spark, "req_seq long, role string", [(1, "Clerk"), (2, "X")]))
    assert by_key(got, "req_seq", "role_id", "reject_reason") == {
        1: (1, None), 2: (None, "Role 'X' does not exist")}


def test_item_at_its_level_is_low_with_no_shortage(spark):
    w = warehouse(spark, items=[{"reorder_level": 5}, {"reorder_level": 5, "is_active": False}],
                  stock_balance=[{"item_id": 1, "available_quantity": 5},
                                 {"item_id": 2, "available_quantity": 0}])
    assert by_key(views.low_stock_alerts(w), "item_id", "shortage_quantity") == {1: D(0)}
    assert by_key(views.stock_status(w), "item_id", "is_low_stock") == {1: True}


def test_dashboard_on_empty_and_partial(spark):
    empty = views.admin_dashboard(warehouse(spark)).head()
    assert (empty.total_sales_orders, empty.revenue_collected) == (0, D(0))
    w = warehouse(
        spark, items=[{}],
        sales_orders=[{"payment_status": "Paid"}, {"payment_status": "Partial"},
                      {"status": "Cancelled"}],
        sales_order_lines=[{"so_id": so, "item_id": 1, "ordered_quantity": 9, "shipped_quantity": 2,
                            "unit_price": "1.25"} for so in (1, 2)])
    row = views.admin_dashboard(w).head()
    assert (row.total_sales_orders, row.so_pending, row.revenue_collected, row.revenue_pending) == (
        3, 2, D("2.5"), D(0))


def test_dashboard_reads_each_source_once(spark, tmp_path):
    w = warehouse(spark, items=[{}], stock_balance=[{"item_id": 1}], sales_orders=[{}],
                  purchase_orders=[{}], delivery_challans=[{}],
                  sales_order_lines=[{"so_id": 1, "item_id": 1, "ordered_quantity": 9}])
    stored = {}
    for name, df in w.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    plan = views.admin_dashboard(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 7  # 4 document tables, stock, items, units


def test_defaults_are_for_absent_columns_only(spark):
    rows = requests(spark, "customer_id long, created_by long, status string", [(1, 1, None)])
    got = C.with_defaults(rows, "sales_orders", AS_OF).head()
    assert (got.status, got.payment_status, got.created_at, got.notes) == (None, "Unpaid", NOW, None)


def test_expressions(spark):
    one = spark.range(1)
    assert one.select(C.line_total(F.lit(D("1.50")), F.lit(D("2.25")))).head()[0] == D("3.38")
    assert one.select(C.pending(F.lit(D("5.00")), F.lit(D("1.25")))).head()[0] == D("3.75")
    assert one.select(C.choose(F.lit("x"), {"y": "z"})).head()[0] is None
    assert one.select(C.is_low(F.lit(None).cast("decimal(12,2)"), F.lit(D(1)))).head()[0] is False
    assert one.select(message(PO_UNKNOWN, F.lit(3))).head()[0] == "Purchase Order 3 not found."
    assert one.select(C.on_hand(F.lit(D("1.00")), F.lit(D("2.00")))).head()[0] == D("3.00")
    values = spark.sql("SELECT * FROM VALUES (''), (NULL), ('a') AS t(v)")
    falsy = values.select(C.is_falsy("v", values.schema["v"].dataType)).collect()
    assert [r[0] for r in falsy] == [True, True, False]
