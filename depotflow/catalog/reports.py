"""Table scans, views, lists and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.catalog.registry import register
from depotflow.plans import lists, views
from depotflow.schemas import MODEL
from depotflow.sources.seeds import SEED_ROWS
from depotflow.sources.star import StarWarehouse

for _table in MODEL:
    if _table not in SEED_ROWS:
        register(f"scan_{_table}", lambda w, t=_table: w[t],
                 f"SELECT {', '.join(MODEL[_table].names)} FROM {_table}")

# --- views -------------------------------------------------------------------

# The checks start from the lines. What is told of an item and of a header is made on its own
# first; a line then meets both.
VIEW_SQL = {
    "labels": "SELECT item_id, item_name, reorder_level, is_active, uom_symbol FROM items NATURAL JOIN unit_of_measure",
    "people": "SELECT user_id AS who, username FROM users",
    "counted": """
        SELECT *, available_quantity <= reorder_level AS is_low_stock
        FROM stock_balance NATURAL JOIN labels WHERE is_active""",
    "stock_status_view": """
        SELECT item_id, item_name, uom_symbol, available_quantity, reserved_quantity,
            CAST(available_quantity + reserved_quantity AS DECIMAL(12,2)) AS total_on_hand,
            reorder_level, is_low_stock, last_updated FROM counted""",
    "low_stock_view": """
        SELECT item_id, item_name, uom_symbol, available_quantity, reorder_level,
            CAST(reorder_level - available_quantity AS DECIMAL(12,2)) AS shortage_quantity, last_updated
        FROM counted WHERE is_low_stock""",
    "po_heads": """
        SELECT p.* EXCLUDE (status, created_by, notes), p.status AS po_status, username AS created_by,
            (SELECT s.supplier_name FROM suppliers s WHERE s.supplier_id = p.supplier_id) AS supplier_name
        FROM people, purchase_orders p WHERE who = p.created_by""",
    "po_view": """
        SELECT * EXCLUDE (reorder_level, is_active)
        FROM purchase_order_lines JOIN labels USING (item_id) JOIN po_heads USING (po_id)""",
    "grn_heads": """
        SELECT grn_id, po_id, status AS grn_status, received_at, username AS received_by
        FROM people, goods_receipts WHERE who = goods_receipts.received_by""",
    "grn_view": """
        SELECT * EXCLUDE (reorder_level, is_active)
        FROM goods_receipt_lines JOIN labels USING (item_id) JOIN grn_heads USING (grn_id)""",
    "buyers": "SELECT customer_id, customer_name, phone AS customer_phone FROM customers",
    "so_heads": """
        SELECT o.* EXCLUDE (status, created_by, notes), o.status AS so_status, username AS created_by
        FROM people, sales_orders o WHERE who = o.created_by""",
    "so_view": """
        SELECT * EXCLUDE (reorder_level, is_active)
        FROM sales_order_lines JOIN labels USING (item_id) JOIN (SELECT * FROM so_heads NATURAL JOIN buyers) USING (so_id)""",
    "dc_heads": """
        SELECT d.* EXCLUDE (status, created_by, notes), d.status AS dc_status, username AS created_by,
            (SELECT b.customer_name FROM buyers b WHERE b.customer_id = (
                SELECT o.customer_id FROM sales_orders o WHERE o.so_id = d.so_id)) AS customer_name
        FROM people, delivery_challans d WHERE who = d.created_by""",
    "dc_view": """
        SELECT * EXCLUDE (reorder_level, is_active)
        FROM delivery_challan_lines JOIN labels USING (item_id) JOIN dc_heads USING (dc_id)""",
    # one pass over each source, a column for each figure
    "sales_figures": """
        SELECT count(*) AS total_sales_orders, count_if(status = 'Pending') AS so_pending,
            count_if(status = 'Processing') AS so_processing, count_if(status = 'Packed') AS so_packed,
            count_if(status IN ('Shipped', 'Delivered')) AS so_completed FROM sales_orders""",
    "purchase_figures": """
        SELECT count(*) AS total_purchase_orders, count_if(status = 'Pending') AS po_pending,
            count_if(status = 'Partially_Received') AS po_partial FROM purchase_orders""",
    "stock_figures": "SELECT count(*) AS total_items, count_if(is_low_stock) AS low_stock_items FROM counted",
    "transit_figures": "SELECT count_if(status = 'Dispatched') AS in_transit FROM delivery_challans",
    "paid_lines": """
        SELECT payment_status, sum(shipped_quantity * unit_price) AS worth
        FROM sales_order_lines NATURAL JOIN (SELECT so_id, payment_status FROM sales_orders) GROUP BY payment_status""",
    "money_figures": """
        SELECT CAST(coalesce(max(worth) FILTER (payment_status = 'Paid'), 0) AS DECIMAL(38,4)) AS revenue_collected,
            CAST(coalesce(max(worth) FILTER (payment_status = 'Unpaid'), 0) AS DECIMAL(38,4)) AS revenue_pending
        FROM paid_lines""",
}

register("stock_status", lambda w: views.stock_status(w).orderBy("item_id"),
         "SELECT * FROM stock_status_view", VIEW_SQL)
register("low_stock_alerts", views.low_stock_alerts, "SELECT * FROM low_stock_view", VIEW_SQL)
register("purchase_order_full",
         lambda w: views.purchase_order_full(w).orderBy(F.desc("po_id"), "po_line_id"),
         "SELECT * FROM po_view", VIEW_SQL)
register("grn_full", lambda w: views.grn_full(w).orderBy(F.desc("grn_id"), "grn_line_id"),
         "SELECT * FROM grn_view", VIEW_SQL)
register("sales_order_full",
         lambda w: views.sales_order_full(w).orderBy(F.desc("so_id"), "so_line_id"),
         "SELECT * FROM so_view", VIEW_SQL)
register("delivery_challan_full",
         lambda w: views.delivery_challan_full(w).orderBy(F.desc("dc_id"), "dc_line_id"),
         "SELECT * FROM dc_view", VIEW_SQL)
register("admin_dashboard", views.admin_dashboard, """
    SELECT * FROM sales_figures CROSS JOIN purchase_figures CROSS JOIN stock_figures
    CROSS JOIN transit_figures CROSS JOIN money_figures""", VIEW_SQL)

# --- lists and lookups ---------------------------------------------------------

register("user_roles", lists.user_roles, """
    SELECT u.user_id, u.username, u.is_active, u.created_at,
        list(r.role_name ORDER BY r.role_name) AS roles
    FROM users u LEFT JOIN user_roles ur ON ur.user_id = u.user_id
    LEFT JOIN roles r ON r.role_id = ur.role_id GROUP BY ALL""")
register("user_primary_role", lists.user_primary_role, """
    SELECT u.user_id, u.username, u.is_active, r.role_name
    FROM users u JOIN user_roles ur ON ur.user_id = u.user_id
    JOIN roles r ON r.role_id = ur.role_id
    QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY r.role_id) = 1""")
register("items_with_uom", lists.items_with_uom, """
    SELECT i.*, m.uom_name, m.uom_symbol
    FROM items i JOIN unit_of_measure m ON m.uom_id = i.uom_id WHERE i.is_active""")
register("active_suppliers", lists.active_suppliers,
         "SELECT * FROM suppliers WHERE is_active")
register("customer_list", lists.customer_list, "SELECT * FROM customers")
register("uom_list", lambda w: lists.uom_list(w).join(
    w["items"].groupBy("uom_id").agg(F.count("*").alias("items")), "uom_id", "left"), """
    SELECT m.uom_id, m.uom_name, m.uom_symbol, count(i.item_id) AS items
    FROM unit_of_measure m LEFT JOIN items i ON i.uom_id = m.uom_id GROUP BY ALL""")


def _asked(w: StarWarehouse, key: str) -> DataFrame:
    """Ids asked for by the users of the event log."""
    return w.raw("events").select(F.col("user_id").alias(key)).distinct()


def _asked_orders(w: StarWarehouse) -> DataFrame:
    """Order ids some of which do not exist: each order key moved on by its customer key."""
    return w.raw("orders").select((F.col("o_orderkey") + F.col("o_custkey")).alias("so_id"))


register("item_lookup", lambda w: lists.item_lookup(w, _asked(w, "item_id")), """
    SELECT i.*, m.uom_name, m.uom_symbol
    FROM items i JOIN unit_of_measure m ON m.uom_id = i.uom_id
    WHERE i.item_id IN (SELECT user_id FROM events)""")

def _lookup_sql(source: str, key: str, asked: str) -> str:
    return f"""
        SELECT s.*, TRUE AS found FROM {source} s
            WHERE s.{key} IN (SELECT k FROM ({asked}))
        UNION ALL BY NAME
        SELECT DISTINCT k AS {key}, FALSE AS found FROM ({asked})
            WHERE k NOT IN (SELECT {key} FROM {source})"""


_EVENT_KEYS = "SELECT user_id AS k FROM events"
_MOVED_KEYS = "SELECT o_orderkey + o_custkey AS k FROM orders"

register("lookup_supplier", lambda w: lists.lookup_by_keys(
    w["suppliers"], _asked(w, "supplier_id"), "supplier_id"),
    _lookup_sql("suppliers", "supplier_id", _EVENT_KEYS))
register("lookup_customer", lambda w: lists.lookup_by_keys(
    w["customers"], w.raw("orders").select(
        (F.col("o_custkey") + F.col("o_orderkey") % 25).alias("customer_id")), "customer_id"),
    _lookup_sql("customers", "customer_id",
                "SELECT o_custkey + o_orderkey % 25 AS k FROM orders"))
register("lookup_purchase_order", lambda w: lists.lookup_by_keys(
    views.purchase_order_full(w),
    w["purchase_orders"].select((F.col("po_id") + 1).alias("po_id")), "po_id"),
    _lookup_sql("po_view", "po_id", "SELECT po_id + 1 AS k FROM purchase_orders"), VIEW_SQL)
register("lookup_goods_receipt", lambda w: lists.lookup_by_keys(
    views.grn_full(w), w["goods_receipts"].select((F.col("grn_id") + 1).alias("grn_id")),
    "grn_id"),
    _lookup_sql("grn_view", "grn_id", "SELECT grn_id + 1 AS k FROM goods_receipts"), VIEW_SQL)
register("lookup_sales_order", lambda w: lists.lookup_by_keys(
    views.sales_order_full(w), _asked_orders(w), "so_id"),
    _lookup_sql("so_view", "so_id", _MOVED_KEYS), VIEW_SQL)
register("lookup_delivery_challan", lambda w: lists.lookup_by_keys(
    views.delivery_challan_full(w), w["delivery_challans"].select("dc_id"), "dc_id"),
    _lookup_sql("dc_view", "dc_id", "SELECT dc_id AS k FROM delivery_challans"), VIEW_SQL)
register("latest_key", lists.latest_keys, """
    SELECT 'purchase_orders' AS document, max(po_id) AS latest_id FROM purchase_orders
    UNION ALL SELECT 'goods_receipts', max(grn_id) FROM goods_receipts
    UNION ALL SELECT 'sales_orders', max(so_id) FROM sales_orders
    UNION ALL SELECT 'delivery_challans', max(dc_id) FROM delivery_challans""")
register("document_status", lambda w: lists.document_status(
    w, "sales_orders", _asked_orders(w)), """
    SELECT so_id, status FROM sales_orders
    WHERE so_id IN (SELECT o_orderkey + o_custkey FROM orders)""")


# Each customer asks for a role named by the rest of its nation key; the fourth
# name is unknown.
ASKED_ROLES = ("Administrator", "Warehouse Staff", "Logistics Staff", "Auditor")


def asked_roles(w: StarWarehouse) -> DataFrame:
    names = F.array(*map(F.lit, ASKED_ROLES))
    return w.raw("customer").select(
        F.col("c_custkey").alias("req_seq"),
        F.col("c_name").alias("username"),
        F.element_at(names, F.col("c_nationkey") % 4 + 1).alias("role"))


ROLE_REQUEST_SQL = {"role_requests": """
    SELECT c_custkey AS req_seq, c_name AS username,
        CASE c_nationkey % 4 WHEN 0 THEN 'Administrator' WHEN 1 THEN 'Warehouse Staff'
            WHEN 2 THEN 'Logistics Staff' ELSE 'Auditor' END AS role FROM customer"""}

register("role_id_by_name", lambda w: lists.role_id_by_name(w, asked_roles(w)), """
    SELECT q.req_seq, q.username, q.role, r.role_id,
        CASE WHEN r.role_id IS NULL THEN 'Role ''' || q.role || ''' does not exist' END
            AS reject_reason
    FROM role_requests q LEFT JOIN roles r ON r.role_name = q.role""", ROLE_REQUEST_SQL)
