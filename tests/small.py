"""Small hand-made warehouses."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from depotflow.functions.columns import with_generated
from depotflow.functions.columns import LINE_PARTS
from depotflow.schemas import MODEL

T0 = dt.datetime(2026, 1, 1)
AS_OF = "2026-02-01 00:00:00"
NOW = dt.datetime(2026, 2, 1)

DEFAULTS = {
    "is_active": True, "created_at": T0, "updated_at": T0, "last_updated": T0,
    "received_quantity": D(0), "shipped_quantity": D(0), "unit_cost": D(1), "unit_price": D(1),
    "payment_status": "Unpaid", "created_by": 1, "received_by": 1, "supplier_id": 1,
    "customer_id": 1, "uom_id": 1, "reorder_level": D(0), "reserved_quantity": D(0),
    "available_quantity": D(0), "uom_name": "Pieces", "uom_symbol": "pcs",
}
STATUS = {"purchase_orders": "Pending", "goods_receipts": "Draft", "sales_orders": "Pending",
          "delivery_challans": "Pending"}


def table(spark, name, rows):
    """``rows`` are dicts; fields left out take a default."""
    model = MODEL[name]
    data = []
    for i, row in enumerate(rows, 1):
        full = {**DEFAULTS, "status": STATUS.get(name), model.key[0]: i,
                "item_name": f"item {i}", "username": f"user {i}", "supplier_name": f"s {i}",
                "customer_name": f"c {i}", "role_name": f"role {i}", **row}
        if name == "goods_receipts" and "received_at" not in row:
            full["received_at"] = T0
        data.append(tuple(
            D(str(full[c.name])) if c.dtype.typeName() == "decimal" and full.get(c.name) is not None
            else full.get(c.name) for c in model.stored))
    schema = [f for f in model.schema if f.name in {c.name for c in model.stored}]
    df = spark.createDataFrame(data, type(model.schema)(schema))
    return with_generated(df, name) if name in LINE_PARTS else df.select(*model.names)


def warehouse(spark, **given):
    """Every table; those not given are empty, but for one user, partner and unit."""
    base = {"users": [{}], "suppliers": [{}], "customers": [{}], "unit_of_measure": [{}]}
    return {name: table(spark, name, given.get(name, base.get(name, []))) for name in MODEL}


def requests(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def outcomes(result, *fields):
    return {r.req_seq: tuple(r[f] for f in fields) if len(fields) > 1 else r[fields[0]]
            for r in result.outcome.collect()}


def by_key(df, key, *fields):
    return {r[key]: tuple(r[f] for f in fields) if len(fields) > 1 else r[fields[0]]
            for r in df.collect()}
