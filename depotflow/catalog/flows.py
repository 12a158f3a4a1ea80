"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.catalog.documents import CONFIRM_SQL
from depotflow.catalog.registry import register
from depotflow.catalog.star_sql import AS_OF as SQL_AS_OF
from depotflow.functions.columns import stamp, with_generated
from depotflow.plans import lists, masters
from depotflow.operators.changes import FLAG, UPDATE
from depotflow.session import fresh_path
from depotflow.sources.copysource import registered
from depotflow.sources.copytext import read_copy_text, write_copy_text
from depotflow.sources.jsonrows import write_json
from depotflow.sources.snapshots import SnapshotStore
from depotflow.sources.star import AS_OF, LOADED_AT, StarWarehouse
from depotflow.streaming import ledger, transitions
from depotflow.streaming.feed import ordered_stream, stream_table
from depotflow.streaming.receipts import confirm_stream

# --- sources and sinks ---------------------------------------------------------


def _through_copy_text(w: StarWarehouse, rows: DataFrame, table: str) -> DataFrame:
    path = fresh_path(w.spark, f"copy-{table}")
    write_copy_text(rows, path, table)
    return read_copy_text(w.spark, path, table)


def prose_customers(w: StarWarehouse) -> DataFrame:
    """Customers whose address is a whole document, with its line ends and tabs."""
    return w.raw("documents").select(
        F.col("doc_id").alias("customer_id"), F.col("source").alias("customer_name"),
        F.nullif(F.col("lang"), F.lit("en")).alias("phone"), F.col("text").alias("address"),
        stamp(LOADED_AT).alias("created_at"))


register("copy_text_read",
         lambda w: _through_copy_text(w, prose_customers(w), "customers"), """
    SELECT doc_id AS customer_id, source AS customer_name, nullif(lang, 'en') AS phone,
        text AS address, TIMESTAMP '2026-01-01 00:00:00' AS created_at FROM documents""")
register("copy_text_lines",
         lambda w: _through_copy_text(w, w["purchase_order_lines"], "purchase_order_lines"),
         "SELECT * FROM purchase_order_lines")


def _received_lines(w: StarWarehouse) -> DataFrame:
    """Lines of which something has come in, tested by the data source while it reads."""
    path = fresh_path(w.spark, "copy-source")
    write_copy_text(w["purchase_order_lines"], path, "purchase_order_lines")
    rows = registered(w.spark).read.format("copytext").options(path=path, table="purchase_order_lines").load()
    return with_generated(rows.filter("received_quantity > 0"), "purchase_order_lines")


register("copy_text_source", _received_lines, "SELECT * FROM purchase_order_lines WHERE received_quantity > 0")


def _through_json(w: StarWarehouse, rows: DataFrame) -> DataFrame:
    path = fresh_path(w.spark, "json")
    write_json(rows, path)
    return w.spark.read.text(path)


def _json_suppliers(w: StarWarehouse) -> DataFrame:
    return _through_json(w, w["suppliers"])


# Whole texts with quotes, line ends and other signs that JSON escapes, and arrays that hold a NULL.
register("json_documents", lambda w: _through_json(w, w.raw("documents").select(
    "doc_id", F.concat("text", F.lit(' "\\ \t\x08\x0c\r/é')).alias("text"),
    F.nullif(F.col("lang"), F.lit("en")).alias("lang"))), r"""
    SELECT '{"doc_id":' || doc_id || ',"text":"' || replace(replace(replace(replace(replace(replace(replace(
            text || ' "\ ' || chr(9) || chr(8) || chr(12) || chr(13) || '/é', '\', '\\'), '"', '\"'), chr(10), '\n'),
            chr(9), '\t'), chr(8), '\b'), chr(12), '\f'), chr(13), '\r')
        || '","lang":' || CASE WHEN lang = 'en' THEN 'null' ELSE '"' || lang || '"' END || '}' AS value FROM documents""")
register("json_user_roles", lambda w: _through_json(w, lists.user_roles(w).select("user_id", "roles")), """
    SELECT '{"user_id":' || user_id || ',"roles":[' || string_agg(coalesce('"' || role_name || '"', 'null'), ','
        ORDER BY role_name) || ']}' AS value
    FROM (SELECT u.user_id, r.role_name FROM users u LEFT JOIN user_roles ur ON ur.user_id = u.user_id
        LEFT JOIN roles r ON r.role_id = ur.role_id) GROUP BY user_id""")
register("json_rows", _json_suppliers, """
    SELECT '{"supplier_id":' || supplier_id || ',"supplier_name":"' || supplier_name
        || '","email":null,"phone":null,"address":null,"is_active":'
        || CASE WHEN is_active THEN 'true' ELSE 'false' END
        || ',"created_at":"2026-01-01T00:00:00.000000"}' AS value FROM suppliers""")


def _stored_suppliers(w: StarWarehouse) -> DataFrame:
    """Store suppliers, switch the indebted ones off, and read what is current."""
    store = SnapshotStore(w.spark, fresh_path(w.spark, "store"))
    store.commit({"suppliers": w["suppliers"]})
    indebted = w.raw("supplier").filter("s_acctbal < 0").select(
        F.col("s_suppkey").alias("supplier_id"))
    tables = store.tables()
    off = masters.deactivate(tables, "suppliers", indebted, "inner").withColumn(FLAG, F.lit(UPDATE))
    store.commit(changes={"suppliers": off}, since=tables)
    return store.tables()["suppliers"]


register("snapshot_write", _stored_suppliers, """
    SELECT supplier_id, supplier_name, email, phone, address,
        is_active AND supplier_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
            AS is_active, created_at FROM suppliers""")

# --- streams ---------------------------------------------------------------------

LEDGER_SQL = {
    "moves": """
        SELECT user_id AS item_id, event_id, CAST(value AS DECIMAL(12,2)) AS quantity,
            CASE event_type WHEN 'signup' THEN 'receipt' WHEN 'purchase' THEN 'reserve'
                WHEN 'view' THEN 'dispatch' WHEN 'click' THEN 'release' END AS kind,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr
        FROM events WHERE event_type IN ('signup', 'purchase', 'view', 'click')
            AND CAST(value AS DECIMAL(12,2)) > 0""",
    "steps": """
        SELECT item_id, 0::BIGINT AS nr, 0::BIGINT AS event_id, '' AS kind,
            CAST(0 AS DECIMAL(12,2)) AS quantity, TRUE AS accepted,
            CAST(0 AS DECIMAL(12,2)) AS available, CAST(0 AS DECIMAL(12,2)) AS reserved
        FROM (SELECT DISTINCT item_id FROM moves)
        UNION ALL
        SELECT item_id, nr, event_id, kind, quantity, ok,
            CAST(CASE WHEN NOT ok THEN available WHEN kind IN ('receipt', 'release')
                THEN available + quantity WHEN kind = 'reserve' THEN available - quantity
                ELSE available END AS DECIMAL(12,2)),
            CAST(CASE WHEN NOT ok THEN reserved WHEN kind = 'reserve' THEN reserved + quantity
                WHEN kind IN ('dispatch', 'release') THEN reserved - quantity
                ELSE reserved END AS DECIMAL(12,2))
        FROM (SELECT m.*, s.available, s.reserved,
                CASE m.kind WHEN 'receipt' THEN TRUE WHEN 'reserve' THEN s.available >= m.quantity
                    ELSE s.reserved >= m.quantity END AS ok
            FROM steps s JOIN moves m ON m.item_id = s.item_id AND m.nr = s.nr + 1)""",
}


def ledger_rows(w: StarWarehouse) -> DataFrame:
    return stream_table(w.raw("events"), "event_id",
                        lambda s: ledger.stock_ledger(ledger.movements(s)))


register("stock_ledger_stream", ledger_rows, """
    SELECT item_id, event_id, kind, quantity, accepted, available AS available_quantity,
        reserved AS reserved_quantity FROM steps WHERE nr > 0""", LEDGER_SQL)
register("low_stock_stream", lambda w: stream_table(
    w.raw("events"), "event_id",
    lambda s: ledger.low_stock(ledger.stock_ledger(ledger.movements(s)), w)), """
    SELECT s.item_id, s.event_id, i.item_name, s.available AS available_quantity,
        i.reorder_level, CAST(i.reorder_level - s.available AS DECIMAL(12,2))
            AS shortage_quantity
    FROM steps s JOIN items i ON i.item_id = s.item_id
    WHERE s.nr > 0 AND s.accepted AND i.is_active AND s.available <= i.reorder_level""",
         LEDGER_SQL)
register("init_stock_stream",
         lambda w: stream_table(w.raw("events"), "event_id", ledger.init_stock), """
    SELECT DISTINCT user_id AS item_id, CAST(0 AS DECIMAL(12,2)) AS available_quantity,
        CAST(0 AS DECIMAL(12,2)) AS reserved_quantity FROM events""")

TRANSITION_SQL = """
    SELECT user_id AS document, event_id, old_status, event_type AS new_status
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old_status
        FROM events) WHERE old_status <> event_type"""
register("status_transitions_stream", lambda w: transitions.transitions_stream(
    ordered_stream(transitions.statuses(w.raw("events")), "event_id"),
    fresh_path(w.spark, "statuses"), fresh_path(w.spark, "stream")), TRANSITION_SQL)
register("status_transitions",
         lambda w: transitions.status_transitions(transitions.statuses(w.raw("events"))),
         TRANSITION_SQL)


def streamed_confirmation(w: StarWarehouse) -> SnapshotStore:
    """Store the buying tables and stream every receipt into them for confirmation."""
    root = fresh_path(w.spark, "store")
    store = SnapshotStore(w.spark, root)
    store.commit({t: w[t] for t in ("goods_receipts", "goods_receipt_lines", "purchase_orders",
                                    "purchase_order_lines", "stock_balance")})
    requests = store.tables()["goods_receipts"].select(F.col("grn_id").alias("req_seq"), "grn_id")
    confirm_stream(ordered_stream(requests, "req_seq"), root, fresh_path(w.spark, "stream"), AS_OF)
    return store


register("confirm_grn_stream",
         lambda w: streamed_confirmation(w).tables()["stock_balance"], f"""
    SELECT b.item_id,
        CAST(b.available_quantity + coalesce(g.qty, 0) AS DECIMAL(12,2)) AS available_quantity,
        b.reserved_quantity,
        CASE WHEN g.qty IS NULL THEN b.last_updated ELSE {SQL_AS_OF} END AS last_updated
    FROM stock_balance b LEFT JOIN (SELECT item_id, sum(qty) AS qty FROM good_lines
        GROUP BY item_id) g ON g.item_id = b.item_id""", CONFIRM_SQL)
