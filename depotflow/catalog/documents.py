"""Document jobs over requests that the star tables give rise to.

Requests use whole tables; ids are moved or quantities lowered by a column so that
each reject reason turns up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.catalog.registry import register
from depotflow.catalog.reports import asked_roles
from depotflow.catalog.star_sql import AS_OF as SQL_AS_OF
from depotflow.functions.columns import stamp
from depotflow.plans import masters, procurement, replay, sales
from depotflow.plans.jobs import After, Result, stamp_changes
from depotflow.schemas import MODEL, QTY
from depotflow.sources.star import AS_OF, LOADED_AT, StarWarehouse

# --- create headers --------------------------------------------------------------


def order_requests(w: StarWarehouse) -> DataFrame:
    return w.raw("customer").select(
        F.col("c_custkey").alias("req_seq"),
        (F.col("c_custkey") + F.col("c_nationkey")).alias("customer_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("bigint")).alias("created_by"),
        F.col("c_mktsegment").alias("notes"))


def create_orders(w: StarWarehouse) -> Result:
    return procurement.create_documents(w, "sales_orders", order_requests(w), AS_OF)


CREATE_SQL = {
    "checked_requests": """
        SELECT c_custkey AS req_seq, c_custkey + c_nationkey AS customer_id,
            CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS BIGINT) END AS created_by,
            c_mktsegment AS notes,
            CASE WHEN NOT c_acctbal >= 0 THEN 'not_null created_by'
                 WHEN c_custkey + c_nationkey NOT IN (SELECT c_custkey FROM customer)
                 THEN 'foreign_key customer_id' END AS reason
        FROM customer""",
    "new_orders": """
        SELECT (SELECT max(so_id) FROM sales_orders)
            + row_number() OVER (ORDER BY req_seq) AS so_id, *
        FROM checked_requests WHERE reason IS NULL""",
}
register("create_documents", lambda w: create_orders(w).outcome, """
    SELECT q.req_seq, n.so_id, CASE WHEN q.reason IS NULL THEN 'accepted' ELSE 'rejected' END
        AS outcome, q.reason
    FROM checked_requests q LEFT JOIN new_orders n ON n.req_seq = q.req_seq""", CREATE_SQL)
register("create_documents_orders", lambda w: create_orders(w).changed["sales_orders"], f"""
    SELECT * FROM sales_orders
    UNION ALL SELECT so_id, customer_id, created_by, 'Pending', 'Unpaid', notes,
        {SQL_AS_OF}, {SQL_AS_OF} FROM new_orders""", CREATE_SQL)
register("create_purchase_orders", lambda w: procurement.create_documents(
    w, "purchase_orders", w.raw("supplier").select(
        F.col("s_suppkey").alias("req_seq"), F.col("s_suppkey").alias("supplier_id"),
        F.col("s_nationkey").cast("bigint").alias("created_by")),
    AS_OF).changed["purchase_orders"], f"""
    SELECT * FROM purchase_orders
    UNION ALL SELECT (SELECT max(po_id) FROM purchase_orders)
            + row_number() OVER (ORDER BY s_suppkey), s_suppkey, s_nationkey, 'Pending', NULL,
        {SQL_AS_OF}, {SQL_AS_OF}, NULL FROM supplier""")
register("create_goods_receipts", lambda w: procurement.create_documents(
    w, "goods_receipts", w["purchase_orders"].select(
        F.col("po_id").alias("req_seq"), "po_id", F.col("created_by").alias("received_by")),
    AS_OF).changed["goods_receipts"], f"""
    SELECT * FROM goods_receipts
    UNION ALL SELECT (SELECT max(grn_id) FROM goods_receipts)
            + row_number() OVER (ORDER BY po_id), po_id, created_by, 'Draft', NULL, {SQL_AS_OF}
        FROM purchase_orders""")

# --- add lines -------------------------------------------------------------------


def po_line_requests(w: StarWarehouse) -> DataFrame:
    """What is still pending, ordered again from the same supplier a month later."""
    return w["purchase_order_lines"].select(
        F.col("po_line_id").alias("req_seq"), (F.col("po_id") + 1).alias("po_id"),
        F.expr("item_id div 2").alias("item_id"), F.col("pending_quantity").alias("quantity"),
        "unit_cost")


def add_po_lines(w: StarWarehouse) -> Result:
    return procurement.add_lines(w, "purchase_order_lines", po_line_requests(w))


def _add_lines_sql(requests: str, table: str, header: str, parent: str, quantity: str) -> dict:
    """The requests of one line table with the reason each is refused for."""
    return {
        "requests": requests,
        "sound_or_not": f"""
            SELECT q.*, CASE WHEN NOT quantity > 0 THEN 'check_range {quantity}'
                WHEN q.{header} NOT IN (SELECT {header} FROM {parent}) THEN 'foreign_key {header}'
                WHEN EXISTS (SELECT 1 FROM {table} t
                    WHERE t.{header} = q.{header} AND t.item_id = q.item_id)
                THEN 'duplicate {header}, item_id' END AS early
            FROM requests q""",
        "judged": f"""
            SELECT *, CASE WHEN early IS NOT NULL THEN early
                WHEN row_number() OVER (PARTITION BY {header}, item_id, early IS NULL
                    ORDER BY req_seq) > 1 THEN 'duplicate {header}, item_id' END AS reason
            FROM sound_or_not""",
    }


def _outcome_sql(header: str) -> str:
    return f"""SELECT req_seq, {header}, item_id, reason,
        CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome FROM judged"""


PO_LINES = _add_lines_sql("""
    SELECT po_line_id AS req_seq, po_id + 1 AS po_id, item_id // 2 AS item_id,
        pending_quantity AS quantity, unit_cost FROM purchase_order_lines""",
    "purchase_order_lines", "po_id", "purchase_orders", "ordered_quantity")
register("add_lines", lambda w: add_po_lines(w).outcome, _outcome_sql("po_id"), PO_LINES)
register("add_lines_table", lambda w: add_po_lines(w).changed["purchase_order_lines"], """
    SELECT * FROM purchase_order_lines
    UNION ALL SELECT (SELECT max(po_line_id) FROM purchase_order_lines)
            + row_number() OVER (ORDER BY req_seq), po_id, item_id, quantity, 0, quantity,
        unit_cost, CAST(quantity * unit_cost AS DECIMAL(14,2))
    FROM judged WHERE reason IS NULL""", PO_LINES)

GRN_LINES = _add_lines_sql("""
    SELECT grn_line_id AS req_seq, grn_id + 2 AS grn_id, item_id // 2 AS item_id,
        CAST(received_quantity - 5 AS DECIMAL(12,2)) AS quantity FROM goods_receipt_lines""",
    "goods_receipt_lines", "grn_id", "goods_receipts", "received_quantity")
register("add_grn_lines", lambda w: procurement.add_lines(
    w, "goods_receipt_lines", w["goods_receipt_lines"].select(
        F.col("grn_line_id").alias("req_seq"), (F.col("grn_id") + 2).alias("grn_id"),
        F.expr("item_id div 2").alias("item_id"),
        (F.col("received_quantity") - 5).alias("quantity"))).outcome,
    _outcome_sql("grn_id"), GRN_LINES)

DC_LINES = _add_lines_sql("""
    SELECT so_line_id AS req_seq, so_id * 2 + 1 AS dc_id, item_id, pending_quantity AS quantity
    FROM sales_order_lines""",
    "delivery_challan_lines", "dc_id", "delivery_challans", "shipped_quantity")
register("add_dc_lines", lambda w: procurement.add_lines(
    w, "delivery_challan_lines", w["sales_order_lines"].select(
        F.col("so_line_id").alias("req_seq"), (F.col("so_id") * 2 + 1).alias("dc_id"),
        "item_id", F.col("pending_quantity").alias("quantity"))).outcome,
    _outcome_sql("dc_id"), DC_LINES)

# --- stock rows --------------------------------------------------------------------


def _active_stock(w: StarWarehouse) -> After:
    active = w["items"].filter("is_active").select("item_id")
    return After(w, {"stock_balance": w["stock_balance"].join(active, "item_id", "left_semi")})


register("init_stock", lambda w: masters.init_stock(_active_stock(w), w["items"], AS_OF), f"""
    SELECT b.* FROM stock_balance b JOIN items i ON i.item_id = b.item_id WHERE i.is_active
    UNION ALL SELECT item_id, 0, 0, {SQL_AS_OF} FROM items WHERE NOT is_active""")
register("stamp_changes", lambda w: stamp_changes(
    w["stock_balance"],
    w["goods_receipt_lines"].join(
        w["goods_receipts"].filter("status = 'Draft'"), "grn_id", "left_semi"),
    "item_id", "last_updated", AS_OF), f"""
    SELECT item_id, available_quantity, reserved_quantity,
        CASE WHEN item_id IN (SELECT l.item_id FROM goods_receipt_lines l
            JOIN goods_receipts g ON g.grn_id = l.grn_id WHERE g.status = 'Draft')
        THEN {SQL_AS_OF} ELSE last_updated END AS last_updated
    FROM stock_balance""")

# --- receive -------------------------------------------------------------------------


def confirm_all(w: StarWarehouse) -> Result:
    """Ask for every receipt to be confirmed, drafts and confirmed ones alike."""
    return procurement.confirm_grn(
        w, w["goods_receipts"].select(F.col("grn_id").alias("req_seq"), "grn_id"), AS_OF)


CONFIRM_SQL = {
    "draft_lines": """
        SELECT g.grn_id, g.po_id, l.grn_line_id, l.item_id, l.received_quantity AS qty,
            p.received_quantity + l.received_quantity > p.ordered_quantity AS over,
            p.po_id IS NULL AS unmatched
        FROM goods_receipts g JOIN goods_receipt_lines l ON l.grn_id = g.grn_id
        LEFT JOIN purchase_order_lines p ON p.po_id = g.po_id AND p.item_id = l.item_id
        WHERE g.status = 'Draft'""",
    "over_lines": "SELECT grn_id, arg_min(item_id, grn_line_id) AS item FROM draft_lines "
                  "WHERE over GROUP BY grn_id",
    "good_lines": "SELECT * FROM draft_lines WHERE grn_id NOT IN (SELECT grn_id FROM over_lines)",
    "good_receipts": """
        SELECT grn_id, po_id FROM goods_receipts WHERE status = 'Draft'
            AND grn_id NOT IN (SELECT grn_id FROM over_lines)""",
    "raised_lines": """
        SELECT p.po_line_id, p.po_id, p.item_id, p.ordered_quantity,
            CAST(p.received_quantity + coalesce(g.qty, 0) AS DECIMAL(12,2)) AS received_quantity,
            CAST(p.ordered_quantity - p.received_quantity - coalesce(g.qty, 0) AS DECIMAL(12,2))
                AS pending_quantity, p.unit_cost, p.line_total
        FROM purchase_order_lines p LEFT JOIN (SELECT po_id, item_id, sum(qty) AS qty
            FROM good_lines GROUP BY ALL) g ON g.po_id = p.po_id AND g.item_id = p.item_id""",
    "order_state": """
        SELECT po_id, bool_and(pending_quantity = 0) AS complete FROM raised_lines
        WHERE po_id IN (SELECT po_id FROM good_receipts) GROUP BY po_id""",
}
register("confirm_grn", lambda w: confirm_all(w).outcome, """
    SELECT g.grn_id AS req_seq, g.grn_id,
        CASE WHEN g.status = 'Confirmed' THEN 'unchanged' WHEN o.item IS NULL THEN 'accepted'
            ELSE 'rejected' END AS outcome,
        'GRN exceeds PO quantity for item_id ' || o.item AS reason,
        coalesce(u.unmatched, FALSE) AS unmatched
    FROM goods_receipts g LEFT JOIN over_lines o ON o.grn_id = g.grn_id
    LEFT JOIN (SELECT grn_id, bool_or(unmatched) AS unmatched FROM draft_lines GROUP BY grn_id) u
        ON u.grn_id = g.grn_id""", CONFIRM_SQL)
register("confirm_grn_stock", lambda w: confirm_all(w).changed["stock_balance"], f"""
    SELECT b.item_id,
        CAST(b.available_quantity + coalesce(g.qty, 0) AS DECIMAL(12,2)) AS available_quantity,
        b.reserved_quantity,
        CASE WHEN g.qty IS NULL THEN b.last_updated ELSE {SQL_AS_OF} END AS last_updated
    FROM stock_balance b LEFT JOIN (SELECT item_id, sum(qty) AS qty FROM good_lines
        GROUP BY item_id) g ON g.item_id = b.item_id""", CONFIRM_SQL)
register("confirm_grn_lines", lambda w: confirm_all(w).changed["purchase_order_lines"],
         "SELECT * FROM raised_lines", CONFIRM_SQL)
register("confirm_grn_orders", lambda w: confirm_all(w).changed["purchase_orders"], f"""
    SELECT p.po_id, p.supplier_id, p.created_by,
        CASE WHEN s.complete THEN 'Completed' WHEN g.po_id IS NOT NULL THEN 'Partially_Received'
            ELSE p.status END AS status,
        p.notes, p.created_at,
        CASE WHEN g.po_id IS NOT NULL THEN {SQL_AS_OF} ELSE p.updated_at END AS updated_at,
        CASE WHEN s.complete THEN {SQL_AS_OF} ELSE p.received_at END AS received_at
    FROM purchase_orders p LEFT JOIN (SELECT DISTINCT po_id FROM good_receipts) g
        ON g.po_id = p.po_id
    LEFT JOIN order_state s ON s.po_id = p.po_id""", CONFIRM_SQL)
register("confirm_grn_receipts", lambda w: confirm_all(w).changed["goods_receipts"], """
    SELECT grn_id, po_id, received_by, CASE WHEN grn_id IN (SELECT grn_id FROM good_receipts)
        THEN 'Confirmed' ELSE status END AS status, notes, received_at FROM goods_receipts""",
         CONFIRM_SQL)

# Several receipts of an order compete for what is open on it, and some ask again.


def competing(w: StarWarehouse) -> After:
    """Each draft receipt comes in four times, with other shares of its lines."""
    copy = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("copy")
    drafts = w["goods_receipts"].filter("status = 'Draft'")
    receipts = drafts.select("*", copy).withColumn("grn_id", F.col("grn_id") * 8 + F.col("copy")).drop("copy")
    lines = (w["goods_receipt_lines"].join(drafts, "grn_id", "left_semi").select("*", copy)
             .filter("(item_id + copy) % 3 <> 0")
             .selectExpr("grn_line_id * 8 + copy AS grn_line_id", "grn_id * 8 + copy AS grn_id", "item_id",
                         "CAST(received_quantity * (copy * 3 % 4 + 2) / 4 AS DECIMAL(12,2)) AS received_quantity"))
    return After(w, {"goods_receipts": receipts, "goods_receipt_lines": lines})


def confirm_competing(w: StarWarehouse, times: int) -> Result:
    """The copies in the order of their number, all of them ``times`` times."""
    tables = competing(w)
    asked = tables["goods_receipts"].select("grn_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("nth"))
    return procurement.confirm_grn(tables, asked.select(
        F.expr("(nth * 8L + grn_id % 8) * 1000000000000L + grn_id").alias("req_seq"), "grn_id"), AS_OF)


def _competing_sql(times: int) -> dict[str, str]:
    """One order after the other: a step per request, which holds what is open of each item and what is confirmed."""
    return {
        "copies": f"""
            SELECT po_id, grn_id * 8 + copy AS grn_id, (nth * 8 + copy) * 1000000000000 + grn_id * 8 + copy AS req_seq,
                row_number() OVER (PARTITION BY po_id ORDER BY nth, copy, grn_id) AS nr
            FROM (SELECT *, unnest([1, 2, 3, 4]) AS copy FROM goods_receipts WHERE status = 'Draft')
            CROSS JOIN (SELECT unnest(range({times})) AS nth)""",
        "copied_lines": """
            SELECT c.grn_id * 8 + copy AS grn_id, item_id, grn_line_id,
                CAST(received_quantity * (copy * 3 % 4 + 2) / 4 AS DECIMAL(12,2)) AS need
            FROM (SELECT l.*, unnest([1, 2, 3, 4]) AS copy FROM goods_receipt_lines l
                JOIN goods_receipts g ON g.grn_id = l.grn_id WHERE g.status = 'Draft') c
            WHERE (item_id + copy) % 3 <> 0""",
        "wanted": """MATERIALIZED
            SELECT c.po_id, c.nr, c.req_seq, c.grn_id,
                list(l.item_id ORDER BY l.grn_line_id) FILTER (l.item_id IS NOT NULL) AS items,
                list(l.need ORDER BY l.grn_line_id) FILTER (l.item_id IS NOT NULL) AS needs,
                bool_or(l.item_id IS NOT NULL AND p.item_id IS NULL) AS unmatched
            FROM copies c LEFT JOIN copied_lines l ON l.grn_id = c.grn_id
            LEFT JOIN purchase_order_lines p ON p.po_id = c.po_id AND p.item_id = l.item_id
            GROUP BY ALL""",
        "turns": """
            SELECT po_id, 0::BIGINT AS nr, 0::BIGINT AS req_seq, 0::BIGINT AS grn_id, FALSE AS unmatched,
                list(item_id ORDER BY item_id) AS kinds, list(pending_quantity ORDER BY item_id) AS open,
                []::BIGINT[] AS done, ''::VARCHAR AS outcome, NULL::BIGINT AS item
            FROM purchase_order_lines GROUP BY po_id
            UNION ALL
            SELECT po_id, nr, req_seq, grn_id, unmatched, kinds,
                CASE WHEN outcome = 'accepted' THEN [open[i] - coalesce(needs[list_position(items, kinds[i])], 0)
                    FOR i IN range(1, len(kinds) + 1)] ELSE open END,
                CASE WHEN outcome = 'accepted' THEN list_append(done, grn_id) ELSE done END, outcome,
                CASE WHEN outcome = 'rejected' THEN items[short[1]] END
            FROM (SELECT *, CASE WHEN list_contains(done, grn_id) THEN 'unchanged'
                    WHEN len(short) > 0 THEN 'rejected' ELSE 'accepted' END AS outcome
                FROM (SELECT t.po_id, w.nr, w.req_seq, w.grn_id, w.unmatched, t.kinds, t.open, t.done,
                        w.items, w.needs,
                        [i FOR i IN range(1, coalesce(len(w.items), 0) + 1)
                            IF w.needs[i] > t.open[list_position(t.kinds, w.items[i])]] AS short
                    FROM turns t JOIN wanted w ON w.po_id = t.po_id AND w.nr = t.nr + 1))""",
    }


for _name, _times in (("confirm_grn_contended", 1), ("confirm_grn_twice", 2)):
    register(_name, lambda w, times=_times: confirm_competing(w, times).outcome, """
        SELECT req_seq, grn_id, outcome, 'GRN exceeds PO quantity for item_id ' || item AS reason, unmatched
        FROM turns WHERE nr > 0""", _competing_sql(_times))

register("cancel_po", lambda w: cancel_orders(w).outcome, """
    SELECT q.req_seq, q.po_id,
        CASE WHEN q.status = 'Pending' AND nr = 1 THEN 'accepted' ELSE 'rejected' END AS outcome,
        CASE WHEN q.status IS NULL THEN 'Purchase Order ' || q.po_id || ' not found.'
             WHEN q.status <> 'Pending' OR nr > 1 THEN 'PO ' || q.po_id || ' cannot be cancelled. '
                || 'Only Pending POs can be cancelled. Current status: '
                || CASE q.status WHEN 'Pending' THEN 'Cancelled' ELSE q.status END || '.' END
             AS reason
    FROM po_cancels q""", {"po_cancels": """
        SELECT l.po_line_id AS req_seq, l.po_id + 1 AS po_id, p.status,
            row_number() OVER (PARTITION BY l.po_id ORDER BY l.po_line_id) AS nr
        FROM purchase_order_lines l LEFT JOIN purchase_orders p ON p.po_id = l.po_id + 1"""})
register("cancel_po_orders", lambda w: cancel_orders(w).changed["purchase_orders"], f"""
    SELECT po_id, supplier_id, created_by, CASE WHEN hit THEN 'Cancelled' ELSE status END
        AS status, notes, created_at,
        CASE WHEN hit THEN {SQL_AS_OF} ELSE updated_at END AS updated_at, received_at
    FROM (SELECT *, status = 'Pending' AND po_id IN (SELECT po_id + 1 FROM purchase_order_lines)
        AS hit FROM purchase_orders)""")


def cancel_orders(w: StarWarehouse) -> Result:
    """One cancel request per order line, for the next order of the supplier."""
    return procurement.cancel_po(w, w["purchase_order_lines"].select(
        F.col("po_line_id").alias("req_seq"), (F.col("po_id") + 1).alias("po_id")), AS_OF)


# --- reserve ---------------------------------------------------------------------------


def unshipped_lines(w: StarWarehouse, how: str = "left_semi") -> DataFrame:
    """Lines of which nothing is shipped, of open orders or, with "left_anti", of the others."""
    open_orders = w["sales_orders"].filter("status IN ('Pending', 'Processing', 'Packed')")
    return w["sales_order_lines"].filter("shipped_quantity = 0").join(
        open_orders, "so_id", how)


def reserve_all(w: StarWarehouse) -> Result:
    """Every unshipped line of an open order comes in as a new line, in order of its id."""
    lines = unshipped_lines(w)
    shipped = w["sales_order_lines"].filter("NOT shipped_quantity <=> 0")
    before = After(w, {
        "sales_order_lines": shipped.unionByName(unshipped_lines(w, "left_anti")),
        "stock_balance": w["stock_balance"].withColumn("reserved_quantity", F.lit(0).cast(QTY)),
    })
    requests = lines.select(
        F.col("so_line_id").alias("req_seq"), "so_id", "item_id",
        F.col("ordered_quantity").alias("quantity"), "unit_price")
    return sales.reserve_stock(before, requests, AS_OF)


RESERVE_SQL = {
    "requests": """
        SELECT l.so_line_id, l.so_id, l.item_id, l.ordered_quantity AS qty, l.unit_price,
            row_number() OVER (PARTITION BY l.item_id ORDER BY l.so_line_id) AS nr
        FROM sales_order_lines l JOIN sales_orders o ON o.so_id = l.so_id
        WHERE l.shipped_quantity = 0 AND o.status IN ('Pending', 'Processing', 'Packed')""",
    "steps": """
        SELECT item_id, 0::BIGINT AS nr, available_quantity AS available,
            CAST(0 AS DECIMAL(12,2)) AS qty, TRUE AS fits, 0::BIGINT AS so_line_id
        FROM stock_balance
        UNION ALL
        SELECT r.item_id, r.nr, CAST(CASE WHEN s.fits THEN s.available - s.qty
                ELSE s.available END AS DECIMAL(12,2)),
            r.qty, r.qty <= CASE WHEN s.fits THEN s.available - s.qty ELSE s.available END,
            r.so_line_id
        FROM steps s JOIN requests r ON r.item_id = s.item_id AND r.nr = s.nr + 1""",
}
register("reserve_stock", lambda w: reserve_all(w).outcome, """
    SELECT s.so_line_id AS req_seq, r.so_id, s.item_id, FALSE AS no_stock_row,
        CASE WHEN s.fits THEN 'accepted' ELSE 'rejected' END AS outcome,
        CASE WHEN NOT s.fits THEN 'Insufficient stock for item_id ' || s.item_id
            || '. Available: ' || s.available || ', Requested: ' || s.qty END AS reason
    FROM steps s JOIN requests r ON r.so_line_id = s.so_line_id WHERE s.nr > 0""", RESERVE_SQL)
register("reserve_stock_balance", lambda w: reserve_all(w).changed["stock_balance"], f"""
    SELECT b.item_id,
        CAST(b.available_quantity - coalesce(t.qty, 0) AS DECIMAL(12,2)) AS available_quantity,
        CAST(coalesce(t.qty, 0) AS DECIMAL(12,2)) AS reserved_quantity,
        CASE WHEN t.qty IS NULL THEN b.last_updated ELSE {SQL_AS_OF} END AS last_updated
    FROM stock_balance b LEFT JOIN (SELECT item_id, sum(qty) AS qty FROM steps
        WHERE nr > 0 AND fits GROUP BY item_id) t ON t.item_id = b.item_id""", RESERVE_SQL)
register("reserve_stock_lines", lambda w: reserve_all(w).changed["sales_order_lines"], """
    SELECT * FROM sales_order_lines WHERE so_line_id NOT IN (SELECT so_line_id FROM requests)
    UNION ALL SELECT (SELECT max(so_line_id) FROM sales_order_lines
            WHERE so_line_id NOT IN (SELECT so_line_id FROM requests))
            + row_number() OVER (ORDER BY r.so_line_id), r.so_id, r.item_id, r.qty, 0, r.qty,
        r.unit_price, CAST(r.qty * r.unit_price AS DECIMAL(14,2))
    FROM requests r JOIN steps s ON s.so_line_id = r.so_line_id WHERE s.nr > 0 AND s.fits""",
         RESERVE_SQL)

# --- advance, ship, deliver, cancel ------------------------------------------------------


def advance_all(w: StarWarehouse) -> Result:
    """One step per order line, for the order after it."""
    return sales.advance_so(w, w["sales_order_lines"].select(
        F.col("so_line_id").alias("req_seq"), (F.col("so_id") + 1).alias("so_id")), AS_OF)


ADVANCE_SQL = {
    "advances": """
        SELECT l.so_line_id AS req_seq, l.so_id + 1 AS so_id, o.status,
            row_number() OVER (PARTITION BY l.so_id ORDER BY l.so_line_id)
                + CASE o.status WHEN 'Pending' THEN 0 ELSE 1 END AS nr
        FROM sales_order_lines l LEFT JOIN sales_orders o ON o.so_id = l.so_id + 1""",
    "advanced": """
        SELECT *, CASE WHEN status NOT IN ('Pending', 'Processing') THEN status
            WHEN nr = 1 THEN 'Pending' WHEN nr = 2 THEN 'Processing' ELSE 'Packed' END AS found
        FROM advances""",
}
register("advance_so", lambda w: advance_all(w).outcome, """
    SELECT req_seq, so_id,
        CASE found WHEN 'Pending' THEN 'Processing' WHEN 'Processing' THEN 'Packed' END
            AS new_status,
        CASE WHEN found IN ('Pending', 'Processing') THEN 'accepted' ELSE 'rejected' END
            AS outcome,
        CASE WHEN status IS NULL THEN 'Sales Order ' || so_id || ' not found.'
             WHEN found NOT IN ('Pending', 'Processing') THEN 'SO ' || so_id
                || ' cannot be advanced from status "' || found
                || '". Only Pending and Processing can be manually advanced.' END AS reason
    FROM (SELECT * REPLACE (CASE WHEN status IS NULL THEN NULL ELSE found END AS found)
        FROM advanced)""", ADVANCE_SQL)
register("advance_so_orders", lambda w: advance_all(w).changed["sales_orders"], f"""
    SELECT o.so_id, o.customer_id, o.created_by, coalesce(a.new_status, o.status) AS status,
        o.payment_status, o.notes, o.created_at,
        CASE WHEN a.new_status IS NULL THEN o.updated_at ELSE {SQL_AS_OF} END AS updated_at
    FROM sales_orders o LEFT JOIN (SELECT so_id,
            CASE max(found) FILTER (nr = 2 AND found = 'Processing')
                WHEN 'Processing' THEN 'Packed' ELSE 'Processing' END AS new_status
        FROM advanced WHERE status IN ('Pending', 'Processing') GROUP BY so_id) a
        ON a.so_id = o.so_id""", ADVANCE_SQL)


def create_challans(w: StarWarehouse) -> Result:
    requests = w.raw("orders").select(
        F.col("o_orderkey").alias("req_seq"),
        (F.col("o_orderkey") + F.col("o_custkey")).alias("so_id"),
        (F.col("o_orderkey") % 30).alias("created_by"),
        F.col("o_orderpriority").alias("vehicle_number"))
    return sales.create_dc(w, requests, AS_OF)


CREATE_DC_SQL = {
    "dc_requests": """
        SELECT q.o_orderkey AS req_seq, q.o_orderkey + q.o_custkey AS so_id,
            q.o_orderkey % 30 AS created_by, q.o_orderpriority AS vehicle_number,
            CASE WHEN s.status IS NULL
                THEN 'Sales Order ' || (q.o_orderkey + q.o_custkey) || ' not found.'
                WHEN s.status <> 'Packed' THEN 'SO ' || s.so_id
                || ' must be Packed before creating a DC. Current status: ' || s.status || '.'
                WHEN q.o_orderkey % 30 >= 25 THEN 'foreign_key created_by' END AS reason
        FROM orders q LEFT JOIN sales_orders s ON s.so_id = q.o_orderkey + q.o_custkey""",
    "new_challans": """
        SELECT (SELECT max(dc_id) FROM delivery_challans)
            + row_number() OVER (ORDER BY req_seq) AS dc_id, *
        FROM dc_requests WHERE reason IS NULL""",
}
register("create_dc", lambda w: create_challans(w).outcome, """
    SELECT q.req_seq, q.so_id, n.dc_id, q.reason,
        CASE WHEN q.reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome
    FROM dc_requests q LEFT JOIN new_challans n ON n.req_seq = q.req_seq""", CREATE_DC_SQL)
register("create_dc_challans", lambda w: create_challans(w).changed["delivery_challans"], f"""
    SELECT * FROM delivery_challans
    UNION ALL SELECT dc_id, so_id, created_by, '', vehicle_number, 'Pending', NULL, NULL, NULL,
        {SQL_AS_OF} FROM new_challans""", CREATE_DC_SQL)


def _all_challans(w: StarWarehouse) -> DataFrame:
    return w["delivery_challans"].select(F.col("dc_id").alias("req_seq"), "dc_id")


def dispatch_all(w: StarWarehouse) -> Result:
    return sales.dispatch_dc(w, _all_challans(w), AS_OF)


DISPATCH_SQL = {
    "open_lines": """
        SELECT d.dc_id, d.so_id, d.status, l.dc_line_id, l.item_id, l.shipped_quantity AS qty,
            s.shipped_quantity + l.shipped_quantity > s.ordered_quantity AS over,
            s.so_id IS NULL AS unmatched
        FROM delivery_challans d JOIN delivery_challan_lines l ON l.dc_id = d.dc_id
        LEFT JOIN sales_order_lines s ON s.so_id = d.so_id AND s.item_id = l.item_id
        WHERE d.status <> 'Dispatched'""",
    "over_lines": "SELECT dc_id, arg_min(item_id, dc_line_id) AS item FROM open_lines "
                  "WHERE over GROUP BY dc_id",
    "good_challans": """
        SELECT dc_id, so_id FROM delivery_challans WHERE status <> 'Dispatched'
            AND dc_id NOT IN (SELECT dc_id FROM over_lines)""",
    "good_lines": "SELECT * FROM open_lines WHERE dc_id NOT IN (SELECT dc_id FROM over_lines)",
    "raised_lines": """
        SELECT s.so_line_id, s.so_id, s.item_id, s.ordered_quantity,
            CAST(s.shipped_quantity + coalesce(g.qty, 0) AS DECIMAL(12,2)) AS shipped_quantity,
            CAST(s.ordered_quantity - s.shipped_quantity - coalesce(g.qty, 0) AS DECIMAL(12,2))
                AS pending_quantity, s.unit_price, s.line_total
        FROM sales_order_lines s LEFT JOIN (SELECT so_id, item_id, sum(qty) AS qty
            FROM good_lines GROUP BY ALL) g ON g.so_id = s.so_id AND g.item_id = s.item_id""",
    "order_state": """
        SELECT so_id, bool_and(pending_quantity = 0) AS complete FROM raised_lines
        WHERE so_id IN (SELECT so_id FROM good_challans) GROUP BY so_id""",
}
register("dispatch_dc", lambda w: dispatch_all(w).outcome, """
    SELECT d.dc_id AS req_seq, d.dc_id,
        CASE WHEN d.status = 'Dispatched' THEN 'unchanged' WHEN o.item IS NULL THEN 'accepted'
            ELSE 'rejected' END AS outcome,
        'Shipment exceeds Sales Order quantity for item_id ' || o.item AS reason,
        coalesce(u.unmatched, FALSE) AS unmatched, d.status = 'Delivered' AS was_delivered
    FROM delivery_challans d LEFT JOIN over_lines o ON o.dc_id = d.dc_id
    LEFT JOIN (SELECT dc_id, bool_or(unmatched) AS unmatched FROM open_lines GROUP BY dc_id) u
        ON u.dc_id = d.dc_id""", DISPATCH_SQL)
register("dispatch_dc_stock", lambda w: dispatch_all(w).changed["stock_balance"], f"""
    SELECT b.item_id, b.available_quantity,
        CAST(b.reserved_quantity - coalesce(g.qty, 0) AS DECIMAL(12,2)) AS reserved_quantity,
        CASE WHEN g.qty IS NULL THEN b.last_updated ELSE {SQL_AS_OF} END AS last_updated
    FROM stock_balance b LEFT JOIN (SELECT item_id, sum(qty) AS qty FROM good_lines
        GROUP BY item_id) g ON g.item_id = b.item_id""", DISPATCH_SQL)
register("dispatch_dc_lines", lambda w: dispatch_all(w).changed["sales_order_lines"],
         "SELECT * FROM raised_lines", DISPATCH_SQL)
register("dispatch_dc_orders", lambda w: dispatch_all(w).changed["sales_orders"], f"""
    SELECT o.so_id, o.customer_id, o.created_by,
        CASE WHEN s.complete THEN 'Shipped' WHEN g.so_id IS NOT NULL THEN 'Processing'
            ELSE o.status END AS status, o.payment_status, o.notes, o.created_at,
        CASE WHEN g.so_id IS NULL THEN o.updated_at ELSE {SQL_AS_OF} END AS updated_at
    FROM sales_orders o LEFT JOIN (SELECT DISTINCT so_id FROM good_challans) g
        ON g.so_id = o.so_id LEFT JOIN order_state s ON s.so_id = o.so_id""", DISPATCH_SQL)
register("dispatch_dc_challans", lambda w: dispatch_all(w).changed["delivery_challans"], f"""
    SELECT dc_id, so_id, created_by, driver_name, vehicle_number,
        CASE WHEN hit THEN 'Dispatched' ELSE status END AS status, notes,
        CASE WHEN hit THEN {SQL_AS_OF} ELSE dispatched_at END AS dispatched_at, delivered_at,
        created_at
    FROM (SELECT *, dc_id IN (SELECT dc_id FROM good_challans) AS hit
        FROM delivery_challans)""", DISPATCH_SQL)


def dispatch_short(w: StarWarehouse) -> Result:
    """All challans where of some items less than reserved, or nothing, is left, so that orders compete for them."""
    left = F.expr("CAST(reserved_quantity * CASE item_id % 20 WHEN 0 THEN 0 WHEN 1 THEN 0.3BD WHEN 2 THEN 0.6BD "
                  "ELSE 1 END AS DECIMAL(12,2))")
    return sales.dispatch_dc(
        After(w, {"stock_balance": w["stock_balance"].withColumn("reserved_quantity", left)}), _all_challans(w), AS_OF)


# An item is at stake if it has something but not enough for all challans that can pass; one step a challan
# with such an item holds what is left of these.
SHORT_SQL = DISPATCH_SQL | {
    "held": """
        SELECT item_id, CAST(reserved_quantity * CASE item_id % 20 WHEN 0 THEN 0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6
            ELSE 1 END AS DECIMAL(12,2)) AS held FROM stock_balance""",
    "fixed": "SELECT l.*, h.held, l.over OR l.qty > h.held AS fails FROM open_lines l JOIN held h ON h.item_id = l.item_id",
    "places": """
        SELECT item_id, any_value(held) AS held, row_number() OVER (ORDER BY item_id) AS place FROM fixed
        WHERE dc_id NOT IN (SELECT dc_id FROM fixed WHERE fails) GROUP BY item_id HAVING sum(qty) > any_value(held)""",
    "wanted": """MATERIALIZED
        SELECT l.dc_id, row_number() OVER (ORDER BY l.dc_id) AS nr,
            list(p.place ORDER BY l.dc_line_id) AS places, list(l.qty ORDER BY l.dc_line_id) AS needs,
            list(l.fails ORDER BY l.dc_line_id) AS fails, list(l.over ORDER BY l.dc_line_id) AS overs,
            list(l.item_id ORDER BY l.dc_line_id) AS items
        FROM fixed l LEFT JOIN places p ON p.item_id = l.item_id
        GROUP BY l.dc_id HAVING count(p.place) > 0 OR bool_or(l.fails)""",
    "turns": """
        SELECT 0::BIGINT AS nr, 0::BIGINT AS dc_id, list(held ORDER BY place) AS held, NULL::BIGINT AS item, FALSE AS over
        FROM places
        UNION ALL
        SELECT nr, dc_id, CASE WHEN len(short) > 0 THEN held ELSE [held[i] - coalesce(
                needs[list_position(places, i)], 0) FOR i IN range(1, len(held) + 1)] END,
            items[short[1]], overs[short[1]]
        FROM (SELECT w.*, t.held, [i FOR i IN range(1, len(w.needs) + 1)
                IF w.fails[i] OR w.needs[i] > t.held[w.places[i]]] AS short
            FROM turns t JOIN wanted w ON w.nr = t.nr + 1)""",
}
register("dispatch_dc_short", lambda w: dispatch_short(w).outcome, """
    SELECT d.dc_id AS req_seq, d.dc_id,
        CASE WHEN d.status = 'Dispatched' THEN 'unchanged' WHEN t.item IS NULL THEN 'accepted' ELSE 'rejected' END
            AS outcome,
        CASE WHEN t.over THEN 'Shipment exceeds Sales Order quantity for item_id ' || t.item
            ELSE 'reserved quantity of item_id ' || t.item || ' would fall below zero' END AS reason,
        coalesce(u.unmatched, FALSE) AS unmatched, d.status = 'Delivered' AS was_delivered
    FROM delivery_challans d LEFT JOIN turns t ON t.dc_id = d.dc_id
    LEFT JOIN (SELECT dc_id, bool_or(unmatched) AS unmatched FROM open_lines GROUP BY dc_id) u
        ON u.dc_id = d.dc_id""", SHORT_SQL)


def deliver_all(w: StarWarehouse) -> Result:
    return sales.deliver_dc(w, _all_challans(w), AS_OF)


register("deliver_dc", lambda w: deliver_all(w).outcome, """
    SELECT dc_id AS req_seq, dc_id,
        CASE WHEN status = 'Delivered' THEN 'unchanged' ELSE 'accepted' END AS outcome,
        status NOT IN ('Dispatched', 'Delivered') AS not_dispatched FROM delivery_challans""")
register("deliver_dc_challans", lambda w: deliver_all(w).changed["delivery_challans"], f"""
    SELECT dc_id, so_id, created_by, driver_name, vehicle_number, 'Delivered' AS status, notes,
        dispatched_at, CASE WHEN status = 'Delivered' THEN delivered_at ELSE {SQL_AS_OF} END
            AS delivered_at, created_at FROM delivery_challans""")
register("deliver_dc_orders", lambda w: deliver_all(w).changed["sales_orders"], f"""
    SELECT so_id, customer_id, created_by, CASE WHEN hit THEN 'Delivered' ELSE status END
        AS status, payment_status, notes, created_at,
        CASE WHEN hit THEN {SQL_AS_OF} ELSE updated_at END AS updated_at
    FROM (SELECT *, so_id IN (SELECT so_id FROM delivery_challans WHERE status <> 'Delivered')
            AND so_id IN (SELECT so_id FROM sales_order_lines GROUP BY so_id
                HAVING bool_and(pending_quantity = 0)) AS hit FROM sales_orders)""")


def cancel_sales(w: StarWarehouse) -> Result:
    requests = w.raw("orders").select(
        F.col("o_orderkey").alias("req_seq"),
        (F.col("o_orderkey") + F.col("o_custkey")).alias("so_id"))
    return sales.cancel_so(w, requests, AS_OF)


CANCEL_SQL = {
    "so_cancels": """
        SELECT q.o_orderkey AS req_seq, q.o_orderkey + q.o_custkey AS so_id, s.status,
            row_number() OVER (PARTITION BY q.o_orderkey + q.o_custkey ORDER BY q.o_orderkey)
                AS nr
        FROM orders q LEFT JOIN sales_orders s ON s.so_id = q.o_orderkey + q.o_custkey""",
    "cancelled": "SELECT DISTINCT so_id FROM so_cancels "
                 "WHERE status IN ('Pending', 'Processing', 'Packed')",
    "released": """
        SELECT item_id, sum(pending_quantity) AS qty FROM sales_order_lines
        WHERE pending_quantity > 0 AND so_id IN (SELECT so_id FROM cancelled) GROUP BY item_id""",
}
register("cancel_so", lambda w: cancel_sales(w).outcome, """
    SELECT req_seq, so_id,
        CASE WHEN status IN ('Pending', 'Processing', 'Packed') AND nr = 1 THEN 'accepted'
            ELSE 'rejected' END AS outcome,
        CASE WHEN status IS NULL THEN 'Sales Order ' || so_id || ' not found.'
             WHEN status IN ('Shipped', 'Delivered', 'Cancelled') THEN 'SO ' || so_id
                || ' cannot be cancelled. Current status: ' || status || '.'
             WHEN nr > 1 THEN 'SO ' || so_id
                || ' cannot be cancelled. Current status: Cancelled.' END AS reason
    FROM so_cancels""", CANCEL_SQL)
register("cancel_so_orders", lambda w: cancel_sales(w).changed["sales_orders"], f"""
    SELECT so_id, customer_id, created_by, CASE WHEN hit THEN 'Cancelled' ELSE status END
        AS status, payment_status, notes, created_at,
        CASE WHEN hit THEN {SQL_AS_OF} ELSE updated_at END AS updated_at
    FROM (SELECT *, so_id IN (SELECT so_id FROM cancelled) AS hit FROM sales_orders)""",
         CANCEL_SQL)
register("cancel_so_stock", lambda w: cancel_sales(w).changed["stock_balance"], f"""
    SELECT b.item_id,
        CAST(b.available_quantity + coalesce(r.qty, 0) AS DECIMAL(12,2)) AS available_quantity,
        CAST(b.reserved_quantity - coalesce(r.qty, 0) AS DECIMAL(12,2)) AS reserved_quantity,
        CASE WHEN r.qty IS NULL THEN b.last_updated ELSE {SQL_AS_OF} END AS last_updated
    FROM stock_balance b LEFT JOIN released r ON r.item_id = b.item_id""", CANCEL_SQL)

# --- master data --------------------------------------------------------------------------


def item_edits(w: StarWarehouse) -> DataFrame:
    """New items for one part type, edits of existing and unknown items for the others."""
    return w.raw("part").select(
        F.col("p_partkey").alias("req_seq"),
        F.when(F.col("p_type") != "SMALL", F.col("p_partkey") + F.col("p_size")).alias("item_id"),
        F.when(F.col("p_size") > 1, F.col("p_brand")).alias("item_name"),
        (F.col("p_retailprice") - 910).cast(QTY).alias("reorder_level"),
        (F.col("p_size") % 6 + 1).cast("bigint").alias("uom_id"))


def upsert_items(w: StarWarehouse) -> Result:
    return masters.upsert_master(w, "items", item_edits(w), AS_OF)


UPSERT_SQL = {
    "edits": """
        SELECT p_partkey AS req_seq,
            CASE WHEN p_type <> 'SMALL' THEN p_partkey + p_size END AS item_id,
            CASE WHEN p_size > 1 THEN p_brand END AS item_name,
            CAST(p_retailprice - 910 AS DECIMAL(12,2)) AS reorder_level,
            CAST(p_size % 6 + 1 AS BIGINT) AS uom_id
        FROM part""",
    "judged": """
        SELECT e.*, i.item_id IS NOT NULL AS known,
            CASE WHEN e.item_id IS NULL AND e.item_name IS NULL THEN 'required field is empty'
                 WHEN e.item_id IS NOT NULL AND i.item_id IS NULL THEN NULL
                 WHEN e.item_name IS NULL THEN 'not_null item_name'
                 WHEN e.reorder_level < 0 THEN 'check_range reorder_level'
                 WHEN e.uom_id = 6 THEN 'foreign_key uom_id' END AS reason
        FROM edits e LEFT JOIN items i ON i.item_id = e.item_id""",
    "new_items": """
        SELECT (SELECT max(item_id) FROM items) + row_number() OVER (ORDER BY req_seq) AS new_id, *
        FROM judged WHERE item_id IS NULL AND reason IS NULL""",
    "last_edits": """
        SELECT * FROM judged WHERE known AND reason IS NULL
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY req_seq DESC) = 1""",
}
register("upsert_master", lambda w: upsert_items(w).outcome, """
    SELECT j.req_seq, coalesce(j.item_id, n.new_id) AS item_id, j.reason,
        CASE WHEN j.reason IS NOT NULL THEN 'rejected'
             WHEN j.item_id IS NULL OR j.known THEN 'accepted' ELSE 'unchanged' END AS outcome
    FROM judged j LEFT JOIN new_items n ON n.req_seq = j.req_seq""", UPSERT_SQL)
register("upsert_master_items", lambda w: upsert_items(w).changed["items"], f"""
    SELECT i.item_id, coalesce(e.item_name, i.item_name) AS item_name, i.description,
        coalesce(e.reorder_level, i.reorder_level) AS reorder_level,
        coalesce(e.uom_id, i.uom_id) AS uom_id, i.is_active, i.created_at
    FROM items i LEFT JOIN last_edits e ON e.item_id = i.item_id
    UNION ALL SELECT new_id, item_name, NULL, reorder_level, uom_id, TRUE, {SQL_AS_OF}
    FROM new_items""", UPSERT_SQL)
register("upsert_master_stock", lambda w: upsert_items(w).changed["stock_balance"], f"""
    SELECT * FROM stock_balance
    UNION ALL SELECT new_id, 0, 0, {SQL_AS_OF} FROM new_items""", UPSERT_SQL)
register("deactivate", lambda w: masters.deactivate(
    w, "suppliers", w.raw("supplier").filter("s_acctbal < 0").select(
        F.col("s_suppkey").alias("supplier_id"))), """
    SELECT supplier_id, supplier_name, email, phone, address,
        is_active AND supplier_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
            AS is_active, created_at FROM suppliers""")


register("deactivate_items", lambda w: masters.deactivate(
    w, "items", w.raw("events").select(F.col("user_id").alias("item_id"))), """
    SELECT item_id, item_name, description, reorder_level, uom_id,
        is_active AND item_id NOT IN (SELECT user_id FROM events) AS is_active, created_at FROM items""")
register("deactivate_users", lambda w: masters.deactivate(
    w, "users", w.raw("nation").filter("n_regionkey = 4").select(
        F.col("n_nationkey").cast("bigint").alias("user_id"))), """
    SELECT user_id, username, is_active AND user_id NOT IN (
        SELECT n_nationkey FROM nation WHERE n_regionkey = 4) AS is_active, created_at FROM users""")


# Partners without an account balance are new, the others edit the row of their key or the next one; some
# give no name or an empty one.
_PARTNERS = {"suppliers": ("supplier", "s_"), "customers": ("customer", "c_")}


def partner_edits(w: StarWarehouse, table: str) -> Result:
    source, c = _PARTNERS[table]
    number = f"{c}{'supp' if c == 's_' else 'cust'}key"
    key, name = (f"{table[:-1]}_{x}" for x in ("id", "name"))
    rows = w.raw(source).selectExpr(
        f"{number} AS req_seq", f"IF({c}acctbal >= 0, {number} + {c}nationkey % 2, NULL) AS {key}",
        f"CASE {c}nationkey % 8 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE concat({c}name, ' Ltd') END AS {name}",
        f"CAST({c}nationkey AS STRING) AS phone")
    return masters.upsert_master(w, table, rows, AS_OF)


def _partner_sql(table: str) -> dict[str, str]:
    source, c = _PARTNERS[table]
    number = f"{c}{'supp' if c == 's_' else 'cust'}key"
    key, name = (f"{table[:-1]}_{x}" for x in ("id", "name"))
    return {
        "asked": f"""
            SELECT {number} AS req_seq, CASE WHEN {c}acctbal >= 0 THEN {number} + {c}nationkey % 2 END AS {key},
                CASE {c}nationkey % 8 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE {c}name || ' Ltd' END AS {name},
                CAST({c}nationkey AS VARCHAR) AS phone FROM {source}""",
        "judged": f"""
            SELECT a.*, t.{key} IS NOT NULL AS known,
                CASE WHEN a.{key} IS NULL AND coalesce(a.{name}, '') = '' THEN 'required field is empty'
                    WHEN t.{key} IS NOT NULL AND a.{name} IS NULL THEN 'not_null {name}' END AS reason
            FROM asked a LEFT JOIN {table} t ON t.{key} = a.{key}""",
        "made": f"""
            SELECT (SELECT max({key}) FROM {table}) + row_number() OVER (ORDER BY req_seq) AS new_id, *
            FROM judged WHERE reason IS NULL AND {key} IS NULL""",
        "kept": f"""
            SELECT * FROM judged WHERE reason IS NULL AND known
            QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY req_seq DESC) = 1""",
    }


for _table in _PARTNERS:
    _key, _name = (f"{_table[:-1]}_{x}" for x in ("id", "name"))
    _more, _new = ("is_active, ", "TRUE, ") if _table == "suppliers" else ("", "")
    _mail = "email" if _table == "suppliers" else None
    register(f"upsert_{_table}", lambda w, t=_table: partner_edits(w, t).outcome, f"""
        SELECT j.req_seq, coalesce(j.{_key}, m.new_id) AS {_key}, j.reason,
            CASE WHEN j.reason IS NOT NULL THEN 'rejected' WHEN j.{_key} IS NULL OR j.known THEN 'accepted'
                ELSE 'unchanged' END AS outcome
        FROM judged j LEFT JOIN made m ON m.req_seq = j.req_seq""", _partner_sql(_table))
    register(f"upsert_{_table}_rows", lambda w, t=_table: partner_edits(w, t).changed[t], f"""
        SELECT t.{_key}, CASE WHEN k.req_seq IS NULL THEN t.{_name} ELSE k.{_name} END AS {_name},
            {'CASE WHEN k.req_seq IS NULL THEN t.email END AS email, ' if _mail else ''}
            CASE WHEN k.req_seq IS NULL THEN t.phone ELSE k.phone END AS phone,
            CASE WHEN k.req_seq IS NULL THEN t.address END AS address, {_more}t.created_at
        FROM {_table} t LEFT JOIN kept k ON k.{_key} = t.{_key}
        UNION ALL SELECT new_id, {_name}, {'NULL, ' if _mail else ''}phone, NULL, {_new}{SQL_AS_OF} FROM made""",
             _partner_sql(_table))


def new_users(w: StarWarehouse) -> Result:
    """Customers ask for accounts; those of one segment and nation share a name."""
    names = w.raw("customer").select(
        F.col("c_custkey").alias("req_seq"),
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("username"))
    requests = asked_roles(w).drop("username").join(names, "req_seq")
    return masters.assign_roles(w, requests, AS_OF)


USER_SQL = {
    "account_requests": """
        SELECT c_custkey AS req_seq, c_mktsegment || '-' || c_nationkey AS username,
            c_nationkey % 4 + 1 AS role_nr FROM customer""",
    "judged": """
        SELECT *, CASE WHEN role_nr = 4 THEN 'Role ''Auditor'' does not exist'
            WHEN row_number() OVER (PARTITION BY username, role_nr = 4 ORDER BY req_seq) > 1
            THEN 'duplicate username' END AS reason FROM account_requests""",
    "new_users": """
        SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY req_seq) AS user_id,
            * FROM judged WHERE reason IS NULL""",
}
register("assign_roles", lambda w: new_users(w).outcome, """
    SELECT j.req_seq, j.username, n.user_id, j.reason,
        CASE WHEN j.reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome
    FROM judged j LEFT JOIN new_users n ON n.req_seq = j.req_seq""", USER_SQL)
register("assign_roles_users", lambda w: new_users(w).changed["users"], f"""
    SELECT * FROM users UNION ALL SELECT user_id, username, TRUE, {SQL_AS_OF}
    FROM new_users""", USER_SQL)
register("assign_roles_user_roles", lambda w: new_users(w).changed["user_roles"], """
    SELECT * FROM user_roles UNION ALL SELECT user_id, CAST(role_nr AS BIGINT)
    FROM new_users""", USER_SQL)

# --- whole scenarios --------------------------------------------------------------------


def no_documents(w: StarWarehouse) -> dict[str, DataFrame]:
    """The document tables without rows, made from their types as deriving them only to drop their rows costs much."""
    return {t: w.spark.createDataFrame([], MODEL[t].schema).filter("false") for t in (
        "purchase_orders", "purchase_order_lines", "goods_receipts", "goods_receipt_lines",
        "sales_orders", "sales_order_lines", "delivery_challans", "delivery_challan_lines")}


def replay_all(w: StarWarehouse) -> DataFrame:
    """Buy what was received so far, sell every order from it, and show the stock left.

    Starts with no documents and no stock. Less is bought than is ordered, so part of
    the reservations are refused; everything that was reserved is shipped.
    """
    zero = F.lit(0).cast(QTY)
    start = After(w, {
        **no_documents(w),
        "stock_balance": w["items"].select(
            "item_id", zero.alias("available_quantity"), zero.alias("reserved_quantity"),
            stamp(LOADED_AT).alias("last_updated")),
    })
    bought = replay.buy(
        start,
        w["purchase_orders"].select(F.col("po_id").alias("req_seq"), "supplier_id", "created_by"),
        w["purchase_order_lines"].select(
            F.col("po_line_id").alias("req_seq"), F.col("po_id").alias("order_seq"), "item_id",
            F.col("received_quantity").alias("quantity"), "unit_cost"),
        AS_OF, strict=False)
    sold = replay.sell(
        bought,
        w["sales_orders"].select(F.col("so_id").alias("req_seq"), "customer_id", "created_by"),
        w["sales_order_lines"].select(
            F.col("so_line_id").alias("req_seq"), F.col("so_id").alias("order_seq"), "item_id",
            F.col("ordered_quantity").alias("quantity"), "unit_price"),
        AS_OF, strict=False)
    return sold["stock_balance"]


REPLAY_SQL = {
    "bought": "SELECT item_id, sum(received_quantity) AS qty FROM purchase_order_lines "
              "WHERE received_quantity > 0 GROUP BY item_id",
    "wanted": """
        SELECT item_id, ordered_quantity AS qty,
            row_number() OVER (PARTITION BY item_id ORDER BY so_line_id) AS nr
        FROM sales_order_lines""",
    "steps": """
        SELECT i.item_id, 0::BIGINT AS nr, CAST(coalesce(b.qty, 0) AS DECIMAL(12,2)) AS available,
            b.qty IS NOT NULL AS touched
        FROM items i LEFT JOIN bought b ON b.item_id = i.item_id
        UNION ALL
        SELECT q.item_id, q.nr, CAST(CASE WHEN q.qty <= s.available THEN s.available - q.qty
            ELSE s.available END AS DECIMAL(12,2)), s.touched
        FROM steps s JOIN wanted q ON q.item_id = s.item_id AND q.nr = s.nr + 1""",
}
register("replay", replay_all, f"""
    SELECT item_id, arg_max(available, nr) AS available_quantity,
        CAST(0 AS DECIMAL(12,2)) AS reserved_quantity,
        CASE WHEN bool_or(touched) THEN {SQL_AS_OF} ELSE TIMESTAMP '{LOADED_AT}' END
            AS last_updated
    FROM steps GROUP BY item_id""", REPLAY_SQL)


def sell_each(w: StarWarehouse) -> tuple:
    """Every packed order sold again as a scenario of its own, some by unknown users or without a quantity."""
    packed = w["sales_orders"].filter("status = 'Packed'")
    lines = w["sales_order_lines"].join(packed, "so_id", "left_semi")
    return replay.sell_each(
        w, packed.select(F.col("so_id").alias("req_seq"), "customer_id",
                         F.expr("IF(so_id % 19 = 0, 99L, created_by)").alias("created_by")),
        lines.select(F.col("so_line_id").alias("req_seq"), F.col("so_id").alias("order_seq"), "item_id",
                     F.expr("ordered_quantity * IF(so_line_id % 23 = 0, 0, 1)").alias("quantity"), "unit_price"), AS_OF)


# As for the challans: items at stake only, and a step for each scenario that has one or a fault of its own.
EACH_SQL = {
    "resold": """
        SELECT o.so_id, l.so_line_id, l.item_id, o.so_id % 19 = 0 AS stranger, b.available_quantity AS free,
            CASE WHEN l.so_line_id % 23 = 0 THEN 0 ELSE l.ordered_quantity END AS need
        FROM sales_orders o JOIN sales_order_lines l ON l.so_id = o.so_id
        JOIN stock_balance b ON b.item_id = l.item_id WHERE o.status = 'Packed'""",
    "places": """
        SELECT item_id, any_value(free) AS free, row_number() OVER (ORDER BY item_id) AS place FROM resold
        GROUP BY item_id HAVING sum(need) > any_value(free)""",
    "wanted": """MATERIALIZED
        SELECT l.so_id, row_number() OVER (ORDER BY l.so_id) AS nr, any_value(l.stranger) AS stranger,
            list(p.place ORDER BY l.so_line_id) AS places, list(l.item_id ORDER BY l.so_line_id) AS items,
            list(l.need ORDER BY l.so_line_id) AS needs
        FROM resold l LEFT JOIN places p ON p.item_id = l.item_id GROUP BY l.so_id""",
    "turns": """
        SELECT 0::BIGINT AS nr, 0::BIGINT AS so_id, FALSE AS stranger, list(free ORDER BY place) AS free,
            NULL::BIGINT AS item, CAST(0 AS DECIMAL(12,2)) AS need, CAST(0 AS DECIMAL(12,2)) AS there
        FROM places
        UNION ALL
        SELECT nr, so_id, stranger, CASE WHEN stranger OR len(short) > 0 THEN free ELSE [free[i] - coalesce(
                needs[list_position(places, i)], 0) FOR i IN range(1, len(free) + 1)] END,
            items[short[1]], needs[short[1]], free[places[short[1]]]
        FROM (SELECT w.*, t.free, [i FOR i IN range(1, len(w.needs) + 1)
                IF w.needs[i] = 0 OR w.needs[i] > t.free[w.places[i]]] AS short
            FROM turns t JOIN wanted w ON w.nr = t.nr + 1)""",
}
register("replay_each", lambda w: sell_each(w)[1], """
    SELECT o.so_id AS order_seq,
        CASE WHEN o.so_id % 19 = 0 OR t.item IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS outcome,
        CASE WHEN o.so_id % 19 = 0 THEN 'create' WHEN t.item IS NOT NULL THEN 'reserve' END AS step,
        CASE WHEN o.so_id % 19 = 0 THEN 'foreign_key created_by'
            WHEN t.need = 0 AND t.item IS NOT NULL THEN 'check_range ordered_quantity'
            WHEN t.item IS NOT NULL THEN 'Insufficient stock for item_id ' || t.item || '. Available: ' || t.there
                || ', Requested: ' || t.need END AS reason
    FROM sales_orders o LEFT JOIN turns t ON t.so_id = o.so_id AND t.nr > 0 WHERE o.status = 'Packed'""", EACH_SQL)
register("replay_each_stock", lambda w: sell_each(w)[0]["stock_balance"], f"""
    SELECT b.item_id, CAST(b.available_quantity - coalesce(s.qty, 0) AS DECIMAL(12,2)) AS available_quantity,
        b.reserved_quantity, CASE WHEN s.qty IS NULL THEN b.last_updated ELSE {SQL_AS_OF} END AS last_updated
    FROM stock_balance b LEFT JOIN (
        SELECT l.item_id, sum(l.ordered_quantity) AS qty FROM sales_order_lines l
        JOIN turns t ON t.so_id = l.so_id WHERE t.nr > 0 AND NOT t.stranger AND t.item IS NULL
        GROUP BY l.item_id) s ON s.item_id = b.item_id""", EACH_SQL)
