"""A small warehouse after one purchase and one sale, as COPY text rows."""

from __future__ import annotations

from pathlib import Path

from depotflow.schemas import MODEL
from depotflow.sources.copytext import read_copy_text

T0 = "2026-04-25 13:56:54.713055"
T1 = "2026-04-25 13:58:28.916984"

# --- fixed values: the rows of the start state and of the documents made on it ---
ROWS = {
    "users": [
        f"1\tadmin\thashed_password_1\tt\t{T0}",
        f"2\twarehouse\thashed_password_2\tt\t{T0}",
        f"3\tlogistics\thashed_password_3\tt\t{T0}",
    ],
    "roles": ["1\tAdministrator", "2\tWarehouse Staff", "3\tLogistics Staff"],
    "user_roles": ["1\t1", "2\t2", "3\t3"],
    "document_types": [
        "1\tPurchase Order\tOutgoing order sent to a supplier for goods.",
        "2\tGoods Receipt Note\tInbound receipt confirming supplier delivery.",
        "3\tSales Order\tOutbound order created on behalf of a customer.",
        "4\tDelivery Challan\tDispatch document assigning driver and vehicle to a shipment.",
    ],
    "unit_of_measure": ["1\tKilogram\tkg", "2\tPieces\tpcs", "3\tLiters\tL", "4\tMeters\tm",
                        "5\tBoxes\tbox"],
    "suppliers": [
        f"1\tAlpha Traders\talpha@traders.com\t0311-1234567\tKarachi, Pakistan\tt\t{T0}",
        f"2\tBeta Supplies\tbeta@supplies.com\t0321-7654321\tLahore, Pakistan\tt\t{T0}",
    ],
    "customers": [
        f"1\tAhmed Enterprises\t0301-1111111\tKarachi, Pakistan\t{T0}",
        f"2\tZara Goods\t0312-2222222\tIslamabad, Pakistan\t{T0}",
    ],
    "items": [
        f"1\tSteel Rods\tConstruction steel rods\t20.00\t1\tt\t{T0}",
        f"2\tCement Bags\t50kg cement bags\t10.00\t2\tt\t{T0}",
        f"3\tPaint Cans\tIndustrial paint\t5.00\t3\tt\t{T0}",
    ],
    "stock_balance": [f"3\t0.00\t0.00\t{T0}", f"1\t90.00\t0.00\t{T1}", f"2\t45.00\t0.00\t{T1}"],
    "purchase_orders": [f"1\t1\t1\tCompleted\t\\N\t{T1}\t{T1}\t{T1}"],
    "purchase_order_lines": ["1\t1\t1\t100.00\t100.00\t15.00", "2\t1\t2\t50.00\t50.00\t8.50"],
    "goods_receipts": [f"1\t1\t1\tConfirmed\t\\N\t{T1}"],
    "goods_receipt_lines": ["1\t1\t1\t100.00", "2\t1\t2\t50.00"],
    "sales_orders": [f"1\t1\t1\tDelivered\tUnpaid\t\\N\t{T1}\t{T1}"],
    "sales_order_lines": ["1\t1\t1\t10.00\t10.00\t25.00", "2\t1\t2\t5.00\t5.00\t12.00"],
    "delivery_challans": [
        f"1\t1\t1\tAhmed Khan\tLHR-789\tDelivered\t\\N\t{T1}\t{T1}\t{T1}"],
    "delivery_challan_lines": ["1\t1\t1\t10.00", "2\t1\t2\t5.00"],
}
USER_COLUMNS = ["user_id", "username", "password_hash", "is_active", "created_at"]


def seed_tables(spark, folder: Path) -> dict:
    tables = {}
    for table in MODEL:
        path = folder / f"{table}.txt"
        path.write_text("\n".join([*ROWS[table], "\\."]) + "\n")
        tables[table] = read_copy_text(
            spark, str(path), table, USER_COLUMNS if table == "users" else None)
    return tables


def start_tables(tables: dict) -> dict:
    """The state before the first document: no documents, zero stock."""
    empty = {t: tables[t].filter("false") for t in (
        "purchase_orders", "purchase_order_lines", "goods_receipts", "goods_receipt_lines",
        "sales_orders", "sales_order_lines", "delivery_challans", "delivery_challan_lines")}
    stock = tables["stock_balance"].selectExpr(
        "item_id", "CAST(0 AS DECIMAL(12,2)) AS available_quantity",
        "CAST(0 AS DECIMAL(12,2)) AS reserved_quantity",
        f"CAST('{T0}' AS TIMESTAMP_NTZ) AS last_updated")
    return {**tables, **empty, "stock_balance": stock}
