"""The data model: typed columns, keys, references, domains and ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ID = T.LongType()
TEXT = T.StringType()
FLAG = T.BooleanType()
QTY = T.DecimalType(12, 2)
MONEY = T.DecimalType(14, 2)
STAMP = T.TimestampNTZType()


@dataclass(frozen=True)
class Column:
    name: str
    dtype: T.DataType
    required: bool = False
    max_length: int | None = None
    # SQL text used on ingest when the field is absent; "as_of" means the batch time.
    default: str | None = None
    generated: bool = False


@dataclass(frozen=True)
class Reference:
    column: str
    parent: str
    cascade: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    domains: tuple[tuple[str, tuple[str, ...]], ...] = ()
    # (column, SQL condition); a row fails only where the condition is false
    ranges: tuple[tuple[str, str], ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, True) for c in self.columns])

    @property
    def stored(self) -> tuple[Column, ...]:
        """Columns that are loaded; the generated ones are computed."""
        return tuple(c for c in self.columns if not c.generated)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required]


def _id(name: str, required: bool = True) -> Column:
    return Column(name, ID, required)


def _text(name: str, limit: int | None = None, required: bool = False,
          default: str | None = None) -> Column:
    return Column(name, TEXT, required, limit, default)


def _qty(name: str, default: str | None = None) -> Column:
    return Column(name, QTY, True, default=default)


def _active() -> Column:
    return Column("is_active", FLAG, True, default="true")


def _stamp(name: str, required: bool = True) -> Column:
    return Column(name, STAMP, required, default="as_of" if required else None)


# --- fixed values: names, types, lengths, domains and rules of the data model ---

PO_STATUS = ("Pending", "Partially_Received", "Completed", "Cancelled")
GRN_STATUS = ("Draft", "Confirmed")
SO_STATUS = ("Pending", "Processing", "Packed", "Shipped", "Delivered", "Cancelled")
PAYMENT_STATUS = ("Unpaid", "Paid", "Partial")
DC_STATUS = ("Pending", "Dispatched", "Delivered", "Failed")

USERS = Table(
    "users",
    (_id("user_id"), _text("username", 100, True), _active(), _stamp("created_at")),
    key=("user_id",), unique=(("username",),),
)
ROLES = Table(
    "roles", (_id("role_id"), _text("role_name", 50, True)),
    key=("role_id",), unique=(("role_name",),),
)
USER_ROLES = Table(
    "user_roles", (_id("user_id"), _id("role_id")),
    key=("user_id", "role_id"),
    references=(Reference("user_id", "users", True), Reference("role_id", "roles", True)),
)
DOCUMENT_TYPES = Table(
    "document_types",
    (_id("document_type_id"), _text("document_name", 100, True), _text("description")),
    key=("document_type_id",), unique=(("document_name",),),
)
UNIT_OF_MEASURE = Table(
    "unit_of_measure",
    (_id("uom_id"), _text("uom_name", 50, True), _text("uom_symbol", 10, True)),
    key=("uom_id",), unique=(("uom_name",),),
)
SUPPLIERS = Table(
    "suppliers",
    (_id("supplier_id"), _text("supplier_name", 150, True), _text("email", 150),
     _text("phone", 30), _text("address"), _active(), _stamp("created_at")),
    key=("supplier_id",),
)
CUSTOMERS = Table(
    "customers",
    (_id("customer_id"), _text("customer_name", 150, True), _text("phone", 30),
     _text("address"), _stamp("created_at")),
    key=("customer_id",),
)
ITEMS = Table(
    "items",
    (_id("item_id"), _text("item_name", 200, True), _text("description"),
     _qty("reorder_level", "0"), _id("uom_id"), _active(), _stamp("created_at")),
    key=("item_id",),
    references=(Reference("uom_id", "unit_of_measure"),),
    ranges=(("reorder_level", "reorder_level >= 0"),),
)
STOCK_BALANCE = Table(
    "stock_balance",
    (_id("item_id"), _qty("available_quantity", "0"), _qty("reserved_quantity", "0"),
     _stamp("last_updated")),
    key=("item_id",),
    references=(Reference("item_id", "items"),),
    ranges=(("available_quantity", "available_quantity >= 0"),
            ("reserved_quantity", "reserved_quantity >= 0")),
)
PURCHASE_ORDERS = Table(
    "purchase_orders",
    (_id("po_id"), _id("supplier_id"), _id("created_by"),
     _text("status", 30, True, "'Pending'"), _text("notes"),
     _stamp("created_at"), _stamp("updated_at"), _stamp("received_at", False)),
    key=("po_id",),
    references=(Reference("supplier_id", "suppliers"), Reference("created_by", "users")),
    domains=(("status", PO_STATUS),),
)
PURCHASE_ORDER_LINES = Table(
    "purchase_order_lines",
    (_id("po_line_id"), _id("po_id"), _id("item_id"), _qty("ordered_quantity"),
     _qty("received_quantity", "0"), Column("pending_quantity", QTY, generated=True),
     _qty("unit_cost", "0"), Column("line_total", MONEY, generated=True)),
    key=("po_line_id",), unique=(("po_id", "item_id"),),
    references=(Reference("po_id", "purchase_orders", True), Reference("item_id", "items")),
    ranges=(("ordered_quantity", "ordered_quantity > 0"),
            ("received_quantity", "received_quantity >= 0")),
)
GOODS_RECEIPTS = Table(
    "goods_receipts",
    (_id("grn_id"), _id("po_id"), _id("received_by"), _text("status", 30, True, "'Draft'"),
     _text("notes"), _stamp("received_at")),
    key=("grn_id",),
    references=(Reference("po_id", "purchase_orders"), Reference("received_by", "users")),
    domains=(("status", GRN_STATUS),),
)
GOODS_RECEIPT_LINES = Table(
    "goods_receipt_lines",
    (_id("grn_line_id"), _id("grn_id"), _id("item_id"), _qty("received_quantity")),
    key=("grn_line_id",), unique=(("grn_id", "item_id"),),
    references=(Reference("grn_id", "goods_receipts", True), Reference("item_id", "items")),
    ranges=(("received_quantity", "received_quantity > 0"),),
)
SALES_ORDERS = Table(
    "sales_orders",
    (_id("so_id"), _id("customer_id"), _id("created_by"),
     _text("status", 30, True, "'Pending'"), _text("payment_status", 30, True, "'Unpaid'"),
     _text("notes"), _stamp("created_at"), _stamp("updated_at")),
    key=("so_id",),
    references=(Reference("customer_id", "customers"), Reference("created_by", "users")),
    domains=(("status", SO_STATUS), ("payment_status", PAYMENT_STATUS)),
)
SALES_ORDER_LINES = Table(
    "sales_order_lines",
    (_id("so_line_id"), _id("so_id"), _id("item_id"), _qty("ordered_quantity"),
     _qty("shipped_quantity", "0"), Column("pending_quantity", QTY, generated=True),
     _qty("unit_price", "0"), Column("line_total", MONEY, generated=True)),
    key=("so_line_id",), unique=(("so_id", "item_id"),),
    references=(Reference("so_id", "sales_orders", True), Reference("item_id", "items")),
    ranges=(("ordered_quantity", "ordered_quantity > 0"),
            ("shipped_quantity", "shipped_quantity >= 0")),
)
DELIVERY_CHALLANS = Table(
    "delivery_challans",
    (_id("dc_id"), _id("so_id"), _id("created_by"), _text("driver_name", 150),
     _text("vehicle_number", 50), _text("status", 30, True, "'Pending'"), _text("notes"),
     _stamp("dispatched_at", False), _stamp("delivered_at", False), _stamp("created_at")),
    key=("dc_id",),
    references=(Reference("so_id", "sales_orders"), Reference("created_by", "users")),
    domains=(("status", DC_STATUS),),
)
DELIVERY_CHALLAN_LINES = Table(
    "delivery_challan_lines",
    (_id("dc_line_id"), _id("dc_id"), _id("item_id"), _qty("shipped_quantity")),
    key=("dc_line_id",), unique=(("dc_id", "item_id"),),
    references=(Reference("dc_id", "delivery_challans", True), Reference("item_id", "items")),
    ranges=(("shipped_quantity", "shipped_quantity > 0"),),
)

MODEL: dict[str, Table] = {
    t.name: t
    for t in (
        USERS, ROLES, USER_ROLES, DOCUMENT_TYPES, UNIT_OF_MEASURE, SUPPLIERS, CUSTOMERS,
        ITEMS, STOCK_BALANCE, PURCHASE_ORDERS, PURCHASE_ORDER_LINES, GOODS_RECEIPTS,
        GOODS_RECEIPT_LINES, SALES_ORDERS, SALES_ORDER_LINES, DELIVERY_CHALLANS,
        DELIVERY_CHALLAN_LINES,
    )
}
