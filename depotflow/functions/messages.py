"""Reject reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: texts of the reject reasons, as clients see them ---
SHORT_STOCK = "Insufficient stock for item_id %s. Available: %s, Requested: %s"
OVER_RECEIPT = "GRN exceeds PO quantity for item_id %s"
OVER_SHIPMENT = "Shipment exceeds Sales Order quantity for item_id %s"
SO_UNKNOWN = "Sales Order %s not found."
SO_NOT_PACKED = "SO %s must be Packed before creating a DC. Current status: %s."
SO_NOT_ADVANCED = ('SO %s cannot be advanced from status "%s". '
                   "Only Pending and Processing can be manually advanced.")
SO_NOT_CANCELLED = "SO %s cannot be cancelled. Current status: %s."
PO_UNKNOWN = "Purchase Order %s not found."
PO_NOT_CANCELLED = ("PO %s cannot be cancelled. Only Pending POs can be cancelled. "
                    "Current status: %s.")
ROLE_UNKNOWN = "Role '%s' does not exist"

# Reasons of our own for rules a database states in its own words.
RESERVED_BELOW_ZERO = "reserved quantity of item_id %s would fall below zero"
DUPLICATE = "duplicate %s"


def message(text: str, *values: Column) -> Column:
    return F.format_string(text, *[v.cast("string") for v in values])
