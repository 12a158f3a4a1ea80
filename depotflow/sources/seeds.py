"""Reference rows every installation starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depotflow.schemas import MODEL

# --- fixed values: start rows of the three reference tables ---
SEED_ROWS = {
    "roles": [
        (1, "Administrator"),
        (2, "Warehouse Staff"),
        (3, "Logistics Staff"),
    ],
    "document_types": [
        (1, "Purchase Order", "Outgoing order sent to a supplier for goods."),
        (2, "Goods Receipt Note", "Inbound receipt confirming supplier delivery."),
        (3, "Sales Order", "Outbound order created on behalf of a customer."),
        (4, "Delivery Challan", "Dispatch document assigning driver and vehicle to a shipment."),
    ],
    "unit_of_measure": [
        (1, "Kilogram", "kg"),
        (2, "Pieces", "pcs"),
        (3, "Liters", "L"),
        (4, "Meters", "m"),
        (5, "Boxes", "box"),
    ],
}


def seed_rows(spark: SparkSession, table: str) -> DataFrame:
    """The start rows as literal rows of the plan.

    Catalyst knows the exact size of literal rows, so it broadcasts them in joins
    without a hint.
    """
    def literal(value: object) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value}L"

    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in SEED_ROWS[table])
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(MODEL[table].names)})")
