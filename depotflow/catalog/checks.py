"""Integrity checks over raw feeds that carry broken rows.

The feeds map whole star tables into the warehouse columns without cleaning, so
the rules have something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.catalog.registry import register
from depotflow.functions.columns import stamp
from depotflow.operators import quality
from depotflow.schemas import QTY
from depotflow.sources.star import LOADED_AT, StarWarehouse


def raw_orders(w: StarWarehouse) -> DataFrame:
    priority = F.col("o_orderpriority")
    return w.raw("orders").select(
        F.col("o_orderkey").alias("so_id"),
        F.when(F.col("o_totalprice") >= 1000, F.col("o_custkey")).alias("customer_id"),
        (F.col("o_orderkey") % 30).alias("created_by"),
        F.when(F.col("o_orderstatus") == "P", "Processing").otherwise(F.col("o_orderstatus"))
        .alias("status"),
        F.when(priority == "1-URGENT", "Paid").when(priority == "2-HIGH", "Partial")
        .when(priority != "5-LOW", priority).alias("payment_status"))


def raw_lines(w: StarWarehouse) -> DataFrame:
    return w.raw("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("so_line_id"),
        F.col("l_orderkey").alias("so_id"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity") - 10).cast(QTY).alias("ordered_quantity"),
        (F.col("l_linenumber") - 2).cast(QTY).alias("shipped_quantity"),
        F.col("l_extendedprice").cast(QTY).alias("unit_price"))


def raw_items(w: StarWarehouse) -> DataFrame:
    return w.raw("documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("text").alias("item_name"),
        F.col("lang").alias("description"),
        (F.col("n_chars") - 500).cast(QTY).alias("reorder_level"),
        (F.col("doc_id") % 7 + 1).alias("uom_id"),
        F.lit(True).alias("is_active"),
        stamp(LOADED_AT).alias("created_at"))


FEEDS = {
    "raw_orders": """
        SELECT o_orderkey AS so_id, CASE WHEN o_totalprice >= 1000 THEN o_custkey END AS customer_id,
            o_orderkey % 30 AS created_by,
            CASE o_orderstatus WHEN 'P' THEN 'Processing' ELSE o_orderstatus END AS status,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'Paid' WHEN '2-HIGH' THEN 'Partial'
                WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS payment_status
        FROM orders""",
    "raw_lines": """
        SELECT l_orderkey * 10 + l_linenumber AS so_line_id, l_orderkey AS so_id,
            l_partkey AS item_id, CAST(l_quantity - 10 AS DECIMAL(12,2)) AS ordered_quantity,
            CAST(l_linenumber - 2 AS DECIMAL(12,2)) AS shipped_quantity,
            CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price
        FROM lineitem""",
    "raw_items": """
        SELECT doc_id AS item_id, text AS item_name, lang AS description,
            CAST(n_chars - 500 AS DECIMAL(12,2)) AS reorder_level, doc_id % 7 + 1 AS uom_id
        FROM documents""",
}


def _row_sql(rule: str, table: str, feed: str, key: str, broken: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{table}' AS table_name, '{field}' AS field, "
        f"CAST({key} AS VARCHAR) AS row_key FROM {feed} WHERE {condition}"
        for field, condition in broken.items())


register("not_null", lambda w: quality.not_null(raw_orders(w), "sales_orders"),
         _row_sql("not_null", "sales_orders", "raw_orders", "so_id", {
             "so_id": "so_id IS NULL", "customer_id": "customer_id IS NULL",
             "created_by": "created_by IS NULL", "status": "status IS NULL",
             "payment_status": "payment_status IS NULL"}), FEEDS)
register("check_range",
         lambda w: quality.check_range(raw_lines(w), "sales_order_lines").unionByName(
             quality.check_range(raw_items(w), "items")),
         _row_sql("check_range", "sales_order_lines", "raw_lines", "so_line_id", {
             "ordered_quantity": "NOT ordered_quantity > 0",
             "shipped_quantity": "NOT shipped_quantity >= 0"}) + " UNION ALL "
         + _row_sql("check_range", "items", "raw_items", "item_id", {
             "reorder_level": "reorder_level < 0"}), FEEDS)
register("status_domain", lambda w: quality.status_domain(raw_orders(w), "sales_orders"),
         _row_sql("status_domain", "sales_orders", "raw_orders", "so_id", {
             "status": "status NOT IN ('Pending', 'Processing', 'Packed', 'Shipped', "
                       "'Delivered', 'Cancelled')",
             "payment_status": "payment_status NOT IN ('Unpaid', 'Paid', 'Partial')"}), FEEDS)
register("varchar_length", lambda w: quality.varchar_length(raw_items(w), "items"),
         _row_sql("varchar_length", "items", "raw_items", "item_id", {
             "item_name": "length(item_name) > 200"}), FEEDS)
register("unique_key", lambda w: quality.unique_key(raw_lines(w), "sales_order_lines"), """
    SELECT 'unique_key' AS rule, 'sales_order_lines' AS table_name, 'so_line_id' AS field,
        CAST(so_line_id AS VARCHAR) AS row_key, count(*) AS rows
    FROM raw_lines GROUP BY so_line_id HAVING count(*) > 1
    UNION ALL SELECT 'unique_key', 'sales_order_lines', 'so_id,item_id',
        so_id || '|' || item_id, count(*)
    FROM raw_lines GROUP BY so_id, item_id HAVING count(*) > 1""", FEEDS)


def _checked_parents(w: StarWarehouse) -> dict[str, DataFrame]:
    solvent = w.raw("customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("customer_id"))
    return {"customers": solvent, "users": w["users"],
            "unit_of_measure": w["unit_of_measure"]}


register("foreign_key",
         lambda w: quality.foreign_key(_checked_parents(w), raw_orders(w), "sales_orders")
         .unionByName(quality.foreign_key(_checked_parents(w), raw_items(w), "items")), """
    SELECT 'foreign_key' AS rule, 'sales_orders' AS table_name, 'customer_id' AS field,
        CAST(so_id AS VARCHAR) AS row_key
    FROM raw_orders WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    UNION ALL SELECT 'foreign_key', 'sales_orders', 'created_by', CAST(so_id AS VARCHAR)
    FROM raw_orders WHERE created_by NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'foreign_key', 'items', 'uom_id', CAST(item_id AS VARCHAR)
    FROM raw_items WHERE uom_id NOT IN (SELECT uom_id FROM unit_of_measure)""", FEEDS)


def _keys_to_delete(w: StarWarehouse) -> DataFrame:
    """Order ids some of which do not exist: each key moved on by its customer key."""
    return w.raw("orders").select((F.col("o_orderkey") + F.col("o_custkey")).alias("so_id"))


_DELETE_SQL = {"outcomes": """
    SELECT k AS so_id,
        CASE WHEN k NOT IN (SELECT so_id FROM sales_orders) THEN 'not_found'
             WHEN k IN (SELECT so_id FROM delivery_challans) THEN 'blocked'
             ELSE 'deleted' END AS outcome,
        CASE WHEN k IN (SELECT so_id FROM delivery_challans) THEN 'delivery_challans' END
            AS blocked_by
    FROM (SELECT DISTINCT o_orderkey + o_custkey AS k FROM orders)"""}

register("cascade_delete",
         lambda w: quality.cascade_delete(w, "sales_orders", _keys_to_delete(w))[1],
         "SELECT * FROM outcomes", _DELETE_SQL)
register("cascade_delete_lines",
         lambda w: quality.cascade_delete(w, "sales_orders", _keys_to_delete(w))[0][
             "sales_order_lines"], """
    SELECT l.* FROM sales_order_lines l
    WHERE l.so_id NOT IN (SELECT so_id FROM outcomes WHERE outcome = 'deleted')""", _DELETE_SQL)


def line_requests(w: StarWarehouse) -> DataFrame:
    return w.raw("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity") - 10).cast(QTY).alias("quantity"))


register("required_fields",
         lambda w: quality.required_fields(line_requests(w), "add_line", "request"), """
    SELECT so_line_id AS request, 'item_id' AS field FROM raw_lines
        WHERE item_id IS NULL OR item_id = 0
    UNION ALL SELECT so_line_id, 'quantity' FROM raw_lines
        WHERE ordered_quantity IS NULL OR ordered_quantity = 0""", FEEDS)


def large_lines(w: StarWarehouse) -> DataFrame:
    """Order lines with quantities so large that some totals do not fit."""
    return w["sales_order_lines"].select(
        "so_line_id", "so_id", "item_id",
        (F.col("ordered_quantity") * 50000000).cast(QTY).alias("ordered_quantity"),
        "shipped_quantity", "unit_price")


_LARGE = {"large_lines": """
    SELECT so_line_id, so_id, item_id,
        CAST(ordered_quantity * 50000000 AS DECIMAL(12,2)) AS ordered_quantity,
        shipped_quantity, unit_price FROM sales_order_lines"""}
_FITS = "CAST(ordered_quantity AS DECIMAL(19,2)) * unit_price < 999999999999.995"

register("generated_columns",
         lambda w: quality.generated_columns(large_lines(w), "sales_order_lines")[0], f"""
    SELECT *, CAST(ordered_quantity - shipped_quantity AS DECIMAL(12,2)) AS pending_quantity,
        CAST(CAST(ordered_quantity AS DECIMAL(19,2)) * unit_price AS DECIMAL(14,2)) AS line_total
    FROM large_lines WHERE {_FITS}""", _LARGE)
register("generated_overflow",
         lambda w: quality.generated_columns(large_lines(w), "sales_order_lines")[1],
         f"SELECT * FROM large_lines WHERE NOT {_FITS}", _LARGE)
