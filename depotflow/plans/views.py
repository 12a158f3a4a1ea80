"""The seven reporting views.

Every function takes a mapping of table name to DataFrame and returns a lazy
DataFrame. Joins carry no broadcast hint: units and roles are literal rows whose
size Catalyst knows, and users, items and partners are broadcast only when their
measured size is under Spark's limit. Beyond it they are sort-merge joins whose
skewed partitions are split at run time. Lines meet their items while they are narrow, headers
meet their names while there is one row of each, and both meet last, in the order of the document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotflow.functions.columns import is_low, on_hand
from depotflow.schemas import QTY

Tables = Mapping[str, DataFrame]
REVENUE = T.DecimalType(38, 4)


def _item_units(tables: Tables) -> DataFrame:
    """Name and unit symbol of each item."""
    units = tables["unit_of_measure"].select("uom_id", "uom_symbol")
    return tables["items"].select("item_id", "item_name", "uom_id").join(units, "uom_id").drop(
        "uom_id")


def _user_names(tables: Tables, as_name: str) -> DataFrame:
    return tables["users"].select("user_id", F.col("username").alias(as_name))


def stock_status(tables: Tables) -> DataFrame:
    units = tables["unit_of_measure"].select("uom_id", "uom_symbol")
    items = tables["items"].filter("is_active").select(
        "item_id", "item_name", "reorder_level", "uom_id")
    return (
        tables["stock_balance"].join(items, "item_id").join(units, "uom_id")
        .select(
            "item_id", "item_name", "uom_symbol", "available_quantity", "reserved_quantity",
            on_hand(F.col("available_quantity"), F.col("reserved_quantity")).cast(QTY)
            .alias("total_on_hand"),
            "reorder_level",
            is_low(F.col("available_quantity"), F.col("reorder_level")).alias("is_low_stock"),
            "last_updated",
        ))


def low_stock_alerts(tables: Tables) -> DataFrame:
    """Low items, largest shortage first; an item exactly at its level stays in."""
    return (
        stock_status(tables).filter("is_low_stock")
        .select(
            "item_id", "item_name", "uom_symbol", "available_quantity", "reorder_level",
            (F.col("reorder_level") - F.col("available_quantity")).cast(QTY)
            .alias("shortage_quantity"),
            "last_updated",
        )
        .orderBy(F.desc("shortage_quantity"), "item_id"))


def purchase_order_full(tables: Tables) -> DataFrame:
    header = tables["purchase_orders"].select(
        "po_id", F.col("status").alias("po_status"), "created_at", "updated_at", "received_at",
        "supplier_id", F.col("created_by").alias("user_id"))
    names = tables["suppliers"].select("supplier_id", "supplier_name")
    named = header.join(names, "supplier_id").join(_user_names(tables, "created_by"), "user_id")
    return (
        tables["purchase_order_lines"].join(_item_units(tables), "item_id")
        .join(named, "po_id")
        .select(
            "po_id", "po_status", "created_at", "updated_at", "received_at", "supplier_id",
            "supplier_name", "created_by", "po_line_id", "item_id", "item_name",
            "ordered_quantity", "received_quantity", "pending_quantity", "unit_cost",
            "line_total", "uom_symbol"))


def grn_full(tables: Tables) -> DataFrame:
    header = tables["goods_receipts"].select(
        "grn_id", "po_id", F.col("status").alias("grn_status"), "received_at",
        F.col("received_by").alias("user_id"))
    return (
        tables["goods_receipt_lines"].join(_item_units(tables), "item_id")
        .join(header.join(_user_names(tables, "received_by"), "user_id"), "grn_id")
        .select(
            "grn_id", "po_id", "grn_status", "received_at", "received_by", "grn_line_id",
            "item_id", "item_name", "received_quantity", "uom_symbol"))


def sales_order_full(tables: Tables) -> DataFrame:
    header = tables["sales_orders"].select(
        "so_id", F.col("status").alias("so_status"), "payment_status", "created_at",
        "updated_at", "customer_id", F.col("created_by").alias("user_id"))
    customer = tables["customers"].select(
        "customer_id", "customer_name", F.col("phone").alias("customer_phone"))
    named = header.join(customer, "customer_id").join(_user_names(tables, "created_by"), "user_id")
    return (
        tables["sales_order_lines"].join(_item_units(tables), "item_id")
        .join(named, "so_id")
        .select(
            "so_id", "so_status", "payment_status", "created_at", "updated_at", "customer_id",
            "customer_name", "customer_phone", "created_by", "so_line_id", "item_id",
            "item_name", "ordered_quantity", "shipped_quantity", "pending_quantity",
            "unit_price", "line_total", "uom_symbol"))


def delivery_challan_full(tables: Tables) -> DataFrame:
    customer = tables["customers"].select("customer_id", "customer_name")
    buyer = tables["sales_orders"].select("so_id", "customer_id").join(customer, "customer_id")
    header = (
        tables["delivery_challans"]
        .select("dc_id", "so_id", F.col("status").alias("dc_status"), "driver_name",
                "vehicle_number", "dispatched_at", "delivered_at", "created_at",
                F.col("created_by").alias("user_id"))
        .join(buyer, "so_id")
        .join(_user_names(tables, "created_by"), "user_id"))
    return (
        tables["delivery_challan_lines"].join(_item_units(tables), "item_id")
        .join(header, "dc_id")
        .select(
            "dc_id", "so_id", "dc_status", "driver_name", "vehicle_number", "dispatched_at",
            "delivered_at", "created_at", "created_by", "customer_name", "dc_line_id",
            "item_id", "item_name", "shipped_quantity", "uom_symbol"))


def admin_dashboard(tables: Tables) -> DataFrame:
    """One row of thirteen figures; each source is read once.

    Shipped value is summed per order before it meets the headers, so orders
    without lines still count. The one-row results are stacked and merged, which
    needs no cross join.
    """
    value = tables["sales_order_lines"].groupBy("so_id").agg(
        F.sum(F.col("shipped_quantity") * F.col("unit_price")).alias("value"))
    status = F.col("status")
    paid = F.col("payment_status")
    sales = tables["sales_orders"].join(value, "so_id", "left").agg(
        F.count("*").alias("total_sales_orders"),
        F.count_if(status == "Pending").alias("so_pending"),
        F.count_if(status == "Processing").alias("so_processing"),
        F.count_if(status == "Packed").alias("so_packed"),
        F.count_if(status.isin("Shipped", "Delivered")).alias("so_completed"),
        F.coalesce(F.sum(F.when(paid == "Paid", F.col("value"))), F.lit(0)).cast(REVENUE)
        .alias("revenue_collected"),
        F.coalesce(F.sum(F.when(paid == "Unpaid", F.col("value"))), F.lit(0)).cast(REVENUE)
        .alias("revenue_pending"))
    purchases = tables["purchase_orders"].agg(
        F.count("*").alias("total_purchase_orders"),
        F.count_if(status == "Pending").alias("po_pending"),
        F.count_if(status == "Partially_Received").alias("po_partial"))
    stock = stock_status(tables).agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("is_low_stock")).alias("low_stock_items"))
    challans = tables["delivery_challans"].agg(
        F.count_if(status == "Dispatched").alias("in_transit"))
    figures = [
        "total_sales_orders", "so_pending", "so_processing", "so_packed", "so_completed",
        "total_purchase_orders", "po_pending", "po_partial", "total_items", "low_stock_items",
        "in_transit", "revenue_collected", "revenue_pending"]
    stacked = (sales.unionByName(purchases, True).unionByName(stock, True)
               .unionByName(challans, True))
    return stacked.agg(*[F.max(c).alias(c) for c in figures])


VIEWS = {
    "stock_status": stock_status,
    "purchase_order_full": purchase_order_full,
    "grn_full": grn_full,
    "sales_order_full": sales_order_full,
    "delivery_challan_full": delivery_challan_full,
    "low_stock_alerts": low_stock_alerts,
    "admin_dashboard": admin_dashboard,
}


def register_views(tables: Tables) -> None:
    """Make each view a temp view, for use from ``spark.sql``."""
    for name, build in VIEWS.items():
        build(tables).createOrReplaceTempView(f"vw_{name}")
