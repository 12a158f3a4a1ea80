"""The whole model checked at once, over tables with faults planted in every one of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotflow.catalog.registry import register
from depotflow.operators.integrity import integrity_report
from depotflow.plans.jobs import After
from depotflow.schemas import MODEL
from depotflow.sources.seeds import SEED_ROWS
from depotflow.sources.star import StarWarehouse

# table -> column -> what it becomes, in words that both engines know
PLANTED = {
    "users": {"username": "CASE user_id % 10 WHEN 3 THEN NULL WHEN 4 THEN 'same' ELSE username END"},
    "roles": {"role_name": "CASE role_id WHEN 2 THEN repeat('r', 51) ELSE role_name END"},
    "user_roles": {"role_id": "CASE user_id % 8 WHEN 4 THEN 77 ELSE role_id END"},
    "document_types": {"document_name": "CASE WHEN document_type_id > 2 THEN 'Order' ELSE document_name END"},
    "unit_of_measure": {"uom_symbol": "CASE uom_id WHEN 5 THEN 'a long symbol' ELSE uom_symbol END"},
    "suppliers": {"supplier_name": "CASE supplier_id % 9 WHEN 0 THEN NULL ELSE supplier_name END",
                  "phone": "CASE supplier_id % 7 WHEN 0 THEN repeat('1', 31) END"},
    "customers": {"customer_name": "CASE customer_id % 11 WHEN 0 THEN repeat('n', 151) ELSE customer_name END"},
    "items": {"reorder_level": "CASE item_id % 13 WHEN 0 THEN -reorder_level ELSE reorder_level END",
              "uom_id": "CASE item_id % 17 WHEN 0 THEN 9 ELSE uom_id END"},
    "stock_balance": {"available_quantity": "available_quantity - 100",
                      "item_id": "CASE item_id % 19 WHEN 0 THEN item_id + 1 ELSE item_id END"},
    "purchase_orders": {"status": "CASE po_id % 5 WHEN 0 THEN 'Open' ELSE status END",
                        "supplier_id": "CASE po_id % 23 WHEN 0 THEN -1 ELSE supplier_id END",
                        "created_by": "CASE po_id % 29 WHEN 0 THEN NULL ELSE created_by END"},
    "purchase_order_lines": {
        "pending_quantity": "CASE po_line_id % 31 WHEN 0 THEN pending_quantity + 1 WHEN 1 THEN NULL "
                            "ELSE pending_quantity END",
        "po_id": "CASE po_line_id % 37 WHEN 0 THEN -po_id ELSE po_id END",
        "item_id": "CASE po_line_id % 3 WHEN 0 THEN item_id + 1 ELSE item_id END"},
    "goods_receipts": {"status": "CASE grn_id % 6 WHEN 1 THEN 'draft' ELSE status END",
                       "received_by": "CASE grn_id % 4 WHEN 1 THEN received_by + 20 ELSE received_by END"},
    "goods_receipt_lines": {"received_quantity": "received_quantity - 3",
                            "grn_id": "CASE grn_line_id % 41 WHEN 0 THEN grn_id + 1 ELSE grn_id END"},
    "sales_orders": {"payment_status": "CASE so_id % 43 WHEN 0 THEN NULL WHEN 1 THEN 'Owed' ELSE payment_status END",
                     "customer_id": "CASE so_id % 8 WHEN 0 THEN customer_id + 40 ELSE customer_id END"},
    "sales_order_lines": {"line_total": "CASE so_line_id % 47 WHEN 0 THEN line_total + 0.01 ELSE line_total END",
                          "so_line_id": "CASE so_line_id % 53 WHEN 0 THEN so_line_id + 1 ELSE so_line_id END",
                          "shipped_quantity": "CASE so_line_id % 59 WHEN 0 THEN -1 ELSE shipped_quantity END"},
    "delivery_challans": {"so_id": "CASE dc_id % 61 WHEN 0 THEN -7 ELSE so_id END",
                          "vehicle_number": "CASE dc_id % 5 WHEN 0 THEN repeat('v', 51) END",
                          "created_at": "CASE dc_id % 67 WHEN 0 THEN NULL ELSE created_at END"},
    "delivery_challan_lines": {"item_id": "CASE dc_line_id % 2 WHEN 0 THEN item_id ELSE 1 END",
                               "dc_id": "CASE dc_line_id % 71 WHEN 0 THEN dc_id * 1000 ELSE dc_id END"},
}


def planted(w: StarWarehouse) -> After:
    """The warehouse with the planted faults."""
    def changed(name: str):
        kinds = {c.name: c.dtype for c in MODEL[name].columns}
        return w[name].withColumns({c: F.expr(e).cast(kinds[c]) for c, e in PLANTED[name].items()})

    return After(w, {name: changed(name) for name in PLANTED})


# --- fixed values: the rules of the model, written a second time for the check ---
REFERENCES = """
    user_roles user_id users user_id / user_roles role_id roles role_id / items uom_id unit_of_measure uom_id /
    stock_balance item_id items item_id / purchase_orders supplier_id suppliers supplier_id /
    purchase_orders created_by users user_id / purchase_order_lines po_id purchase_orders po_id /
    purchase_order_lines item_id items item_id / goods_receipts po_id purchase_orders po_id /
    goods_receipts received_by users user_id / goods_receipt_lines grn_id goods_receipts grn_id /
    goods_receipt_lines item_id items item_id / sales_orders customer_id customers customer_id /
    sales_orders created_by users user_id / sales_order_lines so_id sales_orders so_id /
    sales_order_lines item_id items item_id / delivery_challans so_id sales_orders so_id /
    delivery_challans created_by users user_id / delivery_challan_lines dc_id delivery_challans dc_id /
    delivery_challan_lines item_id items item_id"""
KEYS = """
    users user_id / users username / roles role_id / roles role_name / user_roles user_id,role_id /
    document_types document_type_id / document_types document_name / unit_of_measure uom_id /
    unit_of_measure uom_name / suppliers supplier_id / customers customer_id / items item_id / stock_balance item_id /
    purchase_orders po_id / purchase_order_lines po_line_id / purchase_order_lines po_id,item_id /
    goods_receipts grn_id / goods_receipt_lines grn_line_id / goods_receipt_lines grn_id,item_id / sales_orders so_id /
    sales_order_lines so_line_id / sales_order_lines so_id,item_id / delivery_challans dc_id /
    delivery_challan_lines dc_line_id / delivery_challan_lines dc_id,item_id"""
REQUIRED = {
    "users": "user_id username is_active created_at", "roles": "role_id role_name", "user_roles": "user_id role_id",
    "document_types": "document_type_id document_name", "unit_of_measure": "uom_id uom_name uom_symbol",
    "suppliers": "supplier_id supplier_name is_active created_at", "customers": "customer_id customer_name created_at",
    "items": "item_id item_name reorder_level uom_id is_active created_at",
    "stock_balance": "item_id available_quantity reserved_quantity last_updated",
    "purchase_orders": "po_id supplier_id created_by status created_at updated_at",
    "purchase_order_lines": "po_line_id po_id item_id ordered_quantity received_quantity unit_cost",
    "goods_receipts": "grn_id po_id received_by status received_at",
    "goods_receipt_lines": "grn_line_id grn_id item_id received_quantity",
    "sales_orders": "so_id customer_id created_by status payment_status created_at updated_at",
    "sales_order_lines": "so_line_id so_id item_id ordered_quantity shipped_quantity unit_price",
    "delivery_challans": "dc_id so_id created_by status created_at",
    "delivery_challan_lines": "dc_line_id dc_id item_id shipped_quantity",
}
BROKEN = """
    check_range items reorder_level: reorder_level < 0
    check_range stock_balance available_quantity: available_quantity < 0
    check_range stock_balance reserved_quantity: reserved_quantity < 0
    check_range purchase_order_lines ordered_quantity: ordered_quantity <= 0
    check_range purchase_order_lines received_quantity: received_quantity < 0
    check_range goods_receipt_lines received_quantity: received_quantity <= 0
    check_range sales_order_lines ordered_quantity: ordered_quantity <= 0
    check_range sales_order_lines shipped_quantity: shipped_quantity < 0
    check_range delivery_challan_lines shipped_quantity: shipped_quantity <= 0
    status_domain purchase_orders status: status NOT IN ('Pending', 'Partially_Received', 'Completed', 'Cancelled')
    status_domain goods_receipts status: status NOT IN ('Draft', 'Confirmed')
    status_domain sales_orders status: status NOT IN ('Pending', 'Processing', 'Packed', 'Shipped', 'Delivered', 'Cancelled')
    status_domain sales_orders payment_status: payment_status NOT IN ('Unpaid', 'Paid', 'Partial')
    status_domain delivery_challans status: status NOT IN ('Pending', 'Dispatched', 'Delivered', 'Failed')
    varchar_length users username: length(username) > 100
    varchar_length roles role_name: length(role_name) > 50
    varchar_length document_types document_name: length(document_name) > 100
    varchar_length unit_of_measure uom_name: length(uom_name) > 50
    varchar_length unit_of_measure uom_symbol: length(uom_symbol) > 10
    varchar_length suppliers supplier_name: length(supplier_name) > 150
    varchar_length suppliers email: length(email) > 150
    varchar_length suppliers phone: length(phone) > 30
    varchar_length customers customer_name: length(customer_name) > 150
    varchar_length customers phone: length(phone) > 30
    varchar_length items item_name: length(item_name) > 200
    varchar_length delivery_challans driver_name: length(driver_name) > 150
    varchar_length delivery_challans vehicle_number: length(vehicle_number) > 50
    generated_columns purchase_order_lines pending_quantity: pending_quantity IS DISTINCT FROM ordered_quantity - received_quantity
    generated_columns sales_order_lines pending_quantity: pending_quantity IS DISTINCT FROM ordered_quantity - shipped_quantity
    generated_columns purchase_order_lines line_total: line_total IS DISTINCT FROM CAST(ordered_quantity * unit_cost AS DECIMAL(14,2))
    generated_columns sales_order_lines line_total: line_total IS DISTINCT FROM CAST(ordered_quantity * unit_price AS DECIMAL(14,2))"""


def _report_sql() -> tuple[str, dict[str, str]]:
    """The report as one SELECT per rule over the planted tables."""
    types = {c.name: c.dtype.simpleString().replace("string", "varchar").replace("timestamp_ntz", "timestamp")
             for t in MODEL.values() for c in t.columns}
    extra = {"document_types": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}::BIGINT, '{name}', '{text}')" for i, name, text in SEED_ROWS["document_types"])
        + ") t(document_type_id, document_name, description)"}
    for name, columns in PLANTED.items():
        extra[f"bad_{name}"] = "MATERIALIZED SELECT * REPLACE (" + ", ".join(
            f"CAST({e} AS {types[c]}) AS {c}" for c, e in columns.items()) + f") FROM {name}"
    keys: dict[str, list[str]] = {}
    for part in KEYS.split("/"):
        name, fields = part.split()
        keys.setdefault(name, []).append(fields)

    def shown(fields: str) -> str:
        return "concat_ws('|', " + ", ".join(f"CAST({f} AS VARCHAR)" for f in fields.split(",")) + ")"

    def one(rule: str, name: str, field: str, where: str) -> str:
        return (f"SELECT '{rule}' AS rule, '{name}' AS table_name, '{field}' AS field, {shown(keys[name][0])} AS row_key, "
                f"1::BIGINT AS rows FROM bad_{name} WHERE {where}")

    parts = [one("not_null", name, f, f"{f} IS NULL") for name, fields in REQUIRED.items() for f in fields.split()]
    for line in BROKEN.strip().splitlines():
        head, where = line.strip().split(": ", 1)
        parts.append(one(*head.split(), where))
    for name, many in keys.items():
        for fields in many:
            whole = " AND ".join(f"{f} IS NOT NULL" for f in fields.split(","))
            parts.append(f"SELECT 'unique_key', '{name}', '{fields}', {shown(fields)}, count(*) FROM bad_{name} "
                         f"WHERE {whole} GROUP BY {fields} HAVING count(*) > 1")
    for part in REFERENCES.split("/"):
        name, field, parent, key = part.split()
        parts.append(one("foreign_key", name, field, f"NOT EXISTS (SELECT 1 FROM bad_{parent} p "
                                                     f"WHERE p.{key} = bad_{name}.{field}) AND {field} IS NOT NULL"))
    return "\nUNION ALL ".join(parts), extra


register("integrity_report", lambda w: integrity_report(planted(w)), *_report_sql())
