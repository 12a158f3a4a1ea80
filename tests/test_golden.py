"""The small warehouse: views worked out by hand, and the replay that leads to it."""

from decimal import Decimal as D

import pytest

from depotflow.plans import lists, replay, views
from depotflow.schemas import MODEL
from tests.seed import T1, seed_tables, start_tables


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return {t: df.cache() for t, df in
            seed_tables(spark, tmp_path_factory.mktemp("seed")).items()}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_secret_is_dropped_and_generated_columns_are_there(tables):
    assert tables["users"].columns == ["user_id", "username", "is_active", "created_at"]
    assert rows(tables["purchase_order_lines"], "pending_quantity", "line_total") == [
        (D("0.00"), D("425.00")), (D("0.00"), D("1500.00"))]


def test_stock_status(tables):
    got = rows(views.stock_status(tables), "item_id", "available_quantity", "reserved_quantity",
               "total_on_hand", "reorder_level", "is_low_stock")
    assert got == [(1, D(90), D(0), D(90), D(20), False), (2, D(45), D(0), D(45), D(10), False),
                   (3, D(0), D(0), D(0), D(5), True)]


def test_low_stock_alerts(tables):
    got = rows(views.low_stock_alerts(tables), "item_id", "item_name", "uom_symbol",
               "shortage_quantity")
    assert got == [(3, "Paint Cans", "L", D("5.00"))]


def test_admin_dashboard(tables):
    assert tuple(views.admin_dashboard(tables).head()) == (
        1, 0, 0, 0, 1, 1, 0, 0, 3, 1, 0, D("0.0000"), D("310.0000"))


def test_detail_views(tables):
    assert rows(views.purchase_order_full(tables), "po_line_id", "created_by", "line_total") == [
        (1, "admin", D("1500.00")), (2, "admin", D("425.00"))]
    assert rows(views.sales_order_full(tables), "so_line_id", "customer_name", "line_total") == [
        (1, "Ahmed Enterprises", D("250.00")), (2, "Ahmed Enterprises", D("60.00"))]
    assert views.grn_full(tables).count() == 2
    assert rows(views.delivery_challan_full(tables), "dc_line_id", "driver_name") == [
        (1, "Ahmed Khan"), (2, "Ahmed Khan")]


def test_temp_views(spark, tables):
    views.register_views(tables)
    assert spark.sql("SELECT count(*) FROM vw_stock_status WHERE is_low_stock").head()[0] == 1


def test_roles(tables):
    assert rows(lists.user_primary_role(tables), "username", "role_name") == [
        ("admin", "Administrator"), ("logistics", "Logistics Staff"),
        ("warehouse", "Warehouse Staff")]


def _buy_and_sell(spark, tables, quantity="10"):
    orders = spark.createDataFrame([(1, 1, 1)], "req_seq long, supplier_id long, created_by long")
    lines = spark.sql("""SELECT * FROM VALUES (1L, 1L, 1L, 100, 15.00BD), (2L, 1L, 2L, 50, 8.50BD)
        AS t(req_seq, order_seq, item_id, quantity, unit_cost)""")
    bought = replay.buy(start_tables(tables), orders, lines, T1)
    sales = spark.sql("""SELECT 1L AS req_seq, 1L AS customer_id, 1L AS created_by,
        'Ahmed Khan' AS driver_name, 'LHR-789' AS vehicle_number""")
    sold = spark.sql(f"""SELECT * FROM VALUES (1L, 1L, 1L, {quantity}, 25.00BD),
        (2L, 1L, 2L, 5, 12.00BD) AS t(req_seq, order_seq, item_id, quantity, unit_price)""")
    return replay.sell(bought, sales, sold, T1)


def test_replay_ends_at_the_seed_state(spark, tables):
    end = _buy_and_sell(spark, tables)
    for table in MODEL:
        assert rows(end[table]) == rows(tables[table]), table


def test_scenarios_that_fail_leave_no_trace(spark, tables):
    """Each order for itself: later ones are judged without those that fail."""
    start = start_tables(tables)
    free = {r.item_id: r.available_quantity for r in start["stock_balance"].collect()}
    item, other = sorted(free)[:2]
    bought, judged = replay.buy_each(
        start, spark.createDataFrame([(1, 1, 1), (2, 99, 1), (3, 1, 1), (4, 1, 1)],
                                     "req_seq long, supplier_id long, created_by long"),
        spark.createDataFrame([(1, 1, item, 10, 1), (2, 2, item, 50, 1), (3, 3, item, 50, 1), (4, 3, other, 0, 1),
                               (5, 4, other, 5, 1)],
                              "req_seq long, order_seq long, item_id long, quantity int, unit_cost int"), T1)
    assert {r.order_seq: (r.outcome, r.step, r.reason) for r in judged.collect()} == {
        1: ("accepted", None, None), 2: ("rejected", "create", "foreign_key supplier_id"),
        3: ("rejected", "lines", "check_range ordered_quantity"), 4: ("accepted", None, None)}
    now = {r.item_id: r.available_quantity for r in bought["stock_balance"].collect()}
    assert now == {**free, item: free[item] + 10, other: free[other] + 5}
    # 1 fits, 2 is short on its second line, 3 fits as 2 took nothing, 4 has a fault before it is short, 5 is short first
    have = now[item]
    lines = [(1, 1, item, have - 4), (2, 2, other, 1), (3, 2, item, 5), (4, 3, item, 4), (5, 4, other, 0),
             (6, 4, item, 9), (7, 5, item, 9), (8, 5, other, 0)]
    sold, judged = replay.sell_each(
        bought, spark.createDataFrame([(s, 1, 1) for s in range(1, 6)], "req_seq long, customer_id long, created_by long"),
        spark.createDataFrame([(s, o, i, int(q), 1) for s, o, i, q in lines],
                              "req_seq long, order_seq long, item_id long, quantity int, unit_price int"), T1)
    short = f"Insufficient stock for item_id {item}. Available:"
    assert {r.order_seq: (r.outcome, r.step, r.reason) for r in judged.collect()} == {
        1: ("accepted", None, None), 2: ("rejected", "reserve", f"{short} 4.00, Requested: 5.00"),
        3: ("accepted", None, None), 4: ("rejected", "reserve", "check_range ordered_quantity"),
        5: ("rejected", "reserve", f"{short} 0.00, Requested: 9.00")}
    left = {r.item_id: (r.available_quantity, r.reserved_quantity) for r in sold["stock_balance"].collect()}
    assert left[item][0] == 0 and left[other] == (now[other], left[other][1])
    assert sold["sales_orders"].filter("status = 'Delivered'").count() >= 2


def test_replay_fails_as_a_whole(spark, tables):
    with pytest.raises(replay.ScenarioFailed, match="Insufficient stock for item_id 1"):
        _buy_and_sell(spark, tables, quantity="101")
