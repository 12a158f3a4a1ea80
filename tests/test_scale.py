"""What keeps the work of jobs in proportion to their tables: nothing is derived twice, nothing sorted for its text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from depotflow.catalog import documents
from depotflow.operators import integrity, running
from depotflow.operators.running import line_ids
from depotflow.plans import procurement, sales, views
from depotflow.sources import star as sources
from depotflow.sources.star import STORED, StarWarehouse

from .conftest import SF
from .small import warehouse


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("job", [
    documents.add_po_lines, documents.cancel_orders, documents.confirm_all, documents.dispatch_all, documents.reserve_all,
    documents.advance_all])
def test_jobs_derive_no_table_from_the_lines_again(spark, job):
    assert "lineitem.parquet" not in plan(job(StarWarehouse(spark, SF)).outcome)


def test_a_derived_table_is_stored_once(spark):
    w = StarWarehouse(spark, SF)
    assert all(w[t].inputFiles() == w[t].inputFiles() for t in STORED)
    assert "lineitem.parquet" not in "".join(plan(w[t]) for t in STORED)


def test_line_ids_need_no_window_of_a_document(spark):
    lines = spark.range(3000).select((F.col("id") % 7).alias("doc"), (F.col("id") * 37 % 3001).alias("item"))
    lines = lines.unionByName(spark.createDataFrame([(None, 5), (None, 6)], "doc long, item long"))
    numbered = line_ids(lines, "doc", "item", "nr")
    assert "Window" not in plan(numbered)
    wanted = sorted((r.doc, r.item) for r in lines.dropna().collect())
    # lines without a document come first and are left out
    assert [(r.nr, r.doc, r.item) for r in numbered.orderBy("nr").collect()] == [
        (i, *pair) for i, pair in enumerate(wanted, 3)]


def test_claims_are_numbers_added_up_without_sorting(spark):
    tables = warehouse(spark, items=[{}], purchase_orders=[{}], purchase_order_lines=[
        {"po_id": 1, "item_id": 1, "ordered_quantity": 1}, {"po_id": 8, "item_id": 1, "ordered_quantity": 1}])
    orders = integrity.claims(tables, integrity.KINDS.index(("purchase_orders", "po_id")))
    assert sorted(orders.collect()) == [(1, integrity.HAS), (1, integrity.USES), (8, integrity.USES)]
    pairs = integrity.claims(tables, integrity.KINDS.index(("purchase_order_lines", "po_id,item_id")))
    assert sorted(pairs.collect()) == [(1, 1, integrity.UNIQUE), (8, 1, integrity.UNIQUE)]
    report = integrity.integrity_report(tables)
    assert "SortAggregate" not in plan(report)
    assert [(r.rule, r.field, r.row_key) for r in report.collect()] == [("foreign_key", "po_id", "2")]


def counted(monkeypatch, *modules):
    """The list of what ``durable`` stores in these modules."""
    stored = []
    for module in modules:
        plain = module.durable
        monkeypatch.setattr(module, "durable", lambda df, plain=plain: stored.append(df) or plain(df))
    return stored


def test_lines_are_stored_once_with_their_ids(spark, monkeypatch):
    stored = counted(monkeypatch, running, sources)
    w = StarWarehouse(spark, SF)
    lines = w["goods_receipt_lines"]
    assert len(stored) == 1
    assert "Join" not in plan(lines)
    assert [r.grn_line_id for r in lines.orderBy("grn_id", "item_id").collect()] == list(range(1, lines.count() + 1))


def test_numbering_no_lines_gives_no_lines(spark):
    assert line_ids(spark.createDataFrame([], "doc long, item long"), "doc", "item", "nr").count() == 0


@pytest.mark.parametrize("view, key", [
    (views.purchase_order_full, "po_id"), (views.grn_full, "grn_id"), (views.sales_order_full, "so_id"),
    (views.delivery_challan_full, "dc_id")])
def test_wide_lines_meet_the_document_last(spark, star, view, key):
    joins = [line for line in plan(view(star)).splitlines() if "Join" in line]
    assert f"[{key}#" in joins[0]


def test_reserving_splits_the_lines_without_joining_them_to_themselves(spark, star):
    result = documents.reserve_all(star)
    joins = [line for line in plan(result.changed["sales_order_lines"]).splitlines() if "LeftAnti" in line]
    assert joins and not any("so_line_id" in line for line in joins)


@pytest.mark.parametrize("job, table", [
    (documents.confirm_all, "purchase_orders"), (documents.dispatch_all, "sales_orders")])
def test_large_batches_deal_the_order_lines_once(spark, star, monkeypatch, job, table):
    few = job(star)
    for module in (procurement, sales):
        monkeypatch.setattr(module, "FEW", 0)
    many = job(star)
    assert plan(many.changed[table]).count("LeftSemi") < plan(few.changed[table]).count("LeftSemi")
    for one, other in ((few.outcome, many.outcome), (few.changed[table], many.changed[table])):
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_a_replay_starts_from_tables_it_does_not_derive(spark):
    w = StarWarehouse(spark, SF)
    empty = documents.no_documents(w)
    assert not w._plans
    for name, table in empty.items():
        assert table.isEmpty() and [(f.name, f.dataType) for f in table.schema] == [
            (f.name, f.dataType) for f in w[name].schema]
