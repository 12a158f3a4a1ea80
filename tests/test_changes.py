"""Change sets applied to the old tables give the tables after the jobs."""

import pytest

from depotflow.catalog import documents as jobs
from depotflow.operators.changes import DELETE, FLAG, INSERT, UPDATE, applied, newest
from depotflow.operators.quality import cascade_delete
from depotflow.plans import masters
from depotflow.schemas import MODEL
from tests.compare import spark_rows
from tests.small import AS_OF, by_key, requests, table, warehouse


def same(old, edits, name):
    changes = edits.rows(name)
    assert changes.columns == [*MODEL[name].names, FLAG]
    after = applied(old[name], changes, tuple(MODEL[name].key))
    assert spark_rows(after) == spark_rows(edits[name])
    return {r[FLAG]: r["count"] for r in changes.groupBy(FLAG).count().collect()}


@pytest.mark.parametrize("job", ["create_orders", "add_po_lines", "confirm_all", "cancel_orders", "advance_all",
                                 "create_challans", "dispatch_all", "deliver_all"])
def test_change_sets_of_the_jobs(star, job):
    result = getattr(jobs, job)(star)
    for name in result.changed:
        rows = star[name].count()
        counts = same(star, result.changed, name)
        assert set(counts) <= {INSERT, UPDATE} and counts.get(UPDATE, 0) <= rows


def test_change_sets_of_reservations(star):
    lines = jobs.unshipped_lines(star)
    before = {"sales_order_lines": star["sales_order_lines"].join(lines.select("so_line_id"), "so_line_id", "left_anti"),
              "stock_balance": star["stock_balance"].selectExpr(
                  "item_id", "available_quantity", "CAST(0 AS DECIMAL(12,2)) AS reserved_quantity", "last_updated")}
    edits = jobs.reserve_all(star).changed
    assert set(same(before, edits, "sales_order_lines")) == {INSERT}
    assert set(same(before, edits, "stock_balance")) == {UPDATE}


def test_only_rows_that_change_are_in_a_change_set(spark):
    w = warehouse(spark, items=[{}, {}, {}], stock_balance=[{"item_id": 1}, {"item_id": 2}], suppliers=[{}, {}])
    rows = requests(spark, "req_seq long, item_id long, item_name string, reorder_level int, uom_id long",
                    [(1, 2, "two", 5, 1), (2, None, "new", 1, 1), (3, 99, "none", 1, 1), (4, 3, None, 1, 1)])
    edits = masters.upsert_master(w, "items", rows, AS_OF).changed
    assert same(w, edits, "items") == {UPDATE: 1, INSERT: 1}
    assert same(w, edits, "stock_balance") == {INSERT: 1}
    off = masters.deactivate(w, "suppliers", spark.createDataFrame([(2,), (7,)], "supplier_id long"), "inner")
    assert by_key(off, "supplier_id", "is_active") == {2: False}


def test_deleted_rows_with_their_lines(spark):
    w = warehouse(spark, items=[{}], sales_orders=[{}, {}], sales_order_lines=[
        {"so_id": 1, "item_id": 1, "ordered_quantity": 1}, {"so_id": 2, "item_id": 1, "ordered_quantity": 1}])
    edits, outcome = cascade_delete(w, "sales_orders", spark.createDataFrame([(1,), (9,)], "so_id long"))
    assert by_key(outcome, "so_id", "outcome") == {1: "deleted", 9: "not_found"}
    assert same(w, edits, "sales_orders") == {DELETE: 1} and same(w, edits, "sales_order_lines") == {DELETE: 1}


def test_the_newest_of_several_changes_stays(spark):
    rows = [(1, "a", UPDATE, 2), (1, None, DELETE, 3), (2, "b", INSERT, 1), (2, None, UPDATE, 5)]
    df = spark.createDataFrame(rows, "id long, x string, change string, changed_in long")
    got = newest(df, ("id",), "changed_in")
    assert sorted(map(tuple, got.select("id", "x", "change").collect())) == [(1, None, DELETE), (2, None, UPDATE)]
    old = spark.createDataFrame([(1, "o"), (2, "o"), (3, "o")], "id long, x string")
    assert sorted(map(tuple, applied(old, got, ("id",)).collect())) == [(2, None), (3, "o")]
