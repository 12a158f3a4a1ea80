"""Warehouse tables derived from the star-schema test tables.

Each function returns a DataFrame. Tables that take an exchange of the lines to derive are stored when they
are first asked for, as a job reads them several times; all others are plain projections.
Lines are summed per (document, item) before they meet any other table, so a
document or item that holds a large share of the rows is spread over the pair key
and shrinks on the map side first. Raw quantities are doubles with at most two
decimals: they are summed as they are and rounded once, to DECIMAL(12,2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotflow.functions.columns import stamp, with_generated
from depotflow.operators.running import line_ids
from depotflow.schemas import MODEL, QTY
from depotflow.sources.seeds import SEED_ROWS, seed_rows
from depotflow.sources.snapshots import SnapshotStore
from depotflow.stored import durable, of_relation, sized_relation

LOADED_AT = "2026-01-01 00:00:00"
AS_OF = "2026-02-01 00:00:00"

_L, _I, _S, _D, _TS = (T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(),
                       T.TimestampNTZType())

# stored by the step that numbers their lines
NUMBERED = ("purchase_order_lines", "goods_receipt_lines", "sales_order_lines", "delivery_challan_lines")
# derived by exchanges that a job should make once, however often it reads the table
STORED = (*NUMBERED, "purchase_orders", "goods_receipts", "delivery_challans", "stock_balance")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


STAR_SCHEMAS = {
    "nation": _struct(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _struct(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": _struct(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": _struct(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _struct(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D,
                      o_orderdate=_TS, o_orderpriority=_S),
    "lineitem": _struct(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I,
                        l_quantity=_D, l_extendedprice=_D, l_discount=_D, l_tax=_D,
                        l_returnflag=_S, l_linestatus=_S, l_shipdate=_TS),
    "events": _struct(event_id=_L, ts=_TS, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _struct(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
}


def star(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One raw table, read with its declared schema."""
    return spark.read.schema(STAR_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _null(table: str, column: str) -> Column:
    dtype = next(c.dtype for c in MODEL[table].columns if c.name == column)
    return F.lit(None).cast(dtype).alias(column)


def _loaded(name: str) -> Column:
    return stamp(LOADED_AT).alias(name)


def _qty(value: Column) -> Column:
    return value.cast(QTY)


class StarWarehouse(Mapping[str, DataFrame]):
    """The seventeen warehouse tables over one folder of star-schema Parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._plans: dict[str, DataFrame] = {}
        self._sized: dict[str, JavaObject | None] = {}
        self._derive: dict[str, Callable[[], DataFrame]] = {
            name: getattr(self, name) for name in MODEL if name not in SEED_ROWS
        }

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._plans:
            made = seed_rows(self.spark, table) if table in SEED_ROWS else self._derive[table]()
            self._plans[table] = durable(made) if table in STORED and table not in NUMBERED else made
        return self._plans[table]

    def __iter__(self) -> Iterator[str]:
        return iter(MODEL)

    def __len__(self) -> int:
        return len(MODEL)

    def raw(self, table: str) -> DataFrame:
        rows = star(self.spark, self.sf_dir, table)
        if table not in self._sized:
            self._sized[table] = sized_relation(rows)
        relation = self._sized[table]
        return rows if relation is None else of_relation(self.spark, relation)

    def loaded(self, root: str) -> StarWarehouse:
        """The same warehouse with its tables stored under ``root`` once."""
        store = SnapshotStore(self.spark, root)
        store.commit({name: derive() for name, derive in self._derive.items()})
        stored = StarWarehouse(self.spark, self.sf_dir)
        stored._plans.update(store.tables())
        return stored

    # -- master data ---------------------------------------------------------

    def items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("item_name"),
            _null("items", "description"),
            _qty(F.col("p_size") * 2).alias("reorder_level"),
            (F.col("p_partkey") % 5 + 1).alias("uom_id"),
            (F.col("p_partkey") % 10 != 9).alias("is_active"),
            _loaded("created_at"),
        )

    def suppliers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            _null("suppliers", "email"), _null("suppliers", "phone"),
            _null("suppliers", "address"),
            (F.col("s_suppkey") % 8 != 7).alias("is_active"),
            _loaded("created_at"),
        )

    def customers(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            _null("customers", "phone"), _null("customers", "address"),
            _loaded("created_at"),
        )

    def users(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("user_id"),
            F.col("n_name").alias("username"),
            (F.col("n_nationkey") % 6 != 5).alias("is_active"),
            _loaded("created_at"),
        )

    def user_roles(self) -> DataFrame:
        nation = self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("user_id"),
            F.col("n_regionkey").cast("bigint").alias("region"),
        )
        first = nation.filter("region < 3").select("user_id", (F.col("region") + 1).alias("role_id"))
        second = nation.filter("user_id % 4 = 0").select(
            "user_id", ((F.col("region") + 1) % 3 + 1).alias("role_id"))
        return first.union(second).distinct()

    # -- sales ---------------------------------------------------------------

    def sales_orders(self) -> DataFrame:
        open_status = F.element_at(
            F.array(*map(F.lit, ("Pending", "Processing", "Packed", "Cancelled"))),
            (F.col("o_orderkey") % 4 + 1).cast("int"))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("so_id"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("o_orderkey") % 25).alias("created_by"),
            F.when(F.col("o_orderstatus") == "O", open_status)
            .when(F.col("o_orderstatus") == "P", "Processing")
            .when(F.col("o_orderkey") % 2 == 0, "Shipped")
            .otherwise("Delivered").alias("status"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Paid")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Partial")
            .otherwise("Unpaid").alias("payment_status"),
            _null("sales_orders", "notes"),
            F.col("o_orderdate").alias("created_at"),
            _loaded("updated_at"),
        )

    @cached_property
    def _sold(self) -> DataFrame:
        """Quantities per (order, item) with the state of the order, stored."""
        quantity = F.col("l_quantity")
        summed = self.raw("lineitem").groupBy("l_orderkey", "l_partkey").agg(
            F.sum(quantity).alias("ordered"),
            F.sum(F.when(F.col("l_linestatus") == "F", quantity)).alias("gone"),
        )
        orders = self.raw("orders").select("o_orderkey", "o_orderstatus")
        return durable(summed.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("so_id"),
            F.col("l_partkey").alias("item_id"),
            "o_orderstatus",
            _qty(F.col("ordered")).alias("ordered_quantity"),
            _qty(F.when(F.col("o_orderstatus") == "F", F.col("ordered"))
                 .when(F.col("o_orderstatus") == "P", F.coalesce("gone", F.lit(0)))
                 .otherwise(0)).alias("shipped_quantity"),
        ))

    def sales_order_lines(self) -> DataFrame:
        price = self.raw("part").select(
            F.col("p_partkey").alias("item_id"), _qty(F.col("p_retailprice")).alias("unit_price"))
        lines = self._sold.join(price, "item_id").select(
            "so_id", "item_id", "ordered_quantity", "shipped_quantity", "unit_price")
        return with_generated(line_ids(lines, "so_id", "item_id", "so_line_id"), "sales_order_lines")

    def delivery_challans(self) -> DataFrame:
        orders = self.sales_orders().select("so_id", "created_by", "status")
        gone = self.raw("lineitem").filter("l_linestatus = 'F' AND l_quantity > 0").select(
            F.col("l_orderkey").alias("so_id"))
        part_shipped = (
            orders.filter("status = 'Processing'")
            .join(self.raw("orders").filter("o_orderstatus = 'P'").select(
                F.col("o_orderkey").alias("so_id")), "so_id", "left_semi")
            .join(gone, "so_id", "left_semi"))
        sent = orders.filter("status IN ('Packed', 'Shipped', 'Delivered')").union(part_shipped)
        packed = F.col("status") == "Packed"
        return sent.select(
            (F.col("so_id") * 2 + packed.cast("int")).alias("dc_id"),
            "so_id", "created_by",
            _null("delivery_challans", "driver_name"),
            _null("delivery_challans", "vehicle_number"),
            F.when(packed, "Pending").when(F.col("status") == "Delivered", "Delivered")
            .otherwise("Dispatched").alias("status"),
            _null("delivery_challans", "notes"),
            _null("delivery_challans", "dispatched_at"),
            _null("delivery_challans", "delivered_at"),
            _loaded("created_at"),
        )

    def delivery_challan_lines(self) -> DataFrame:
        packed = (F.col("o_orderstatus") == "O") & (F.col("so_id") % 4 == 2)
        first_part = packed & (F.col("item_id") % 3 != 0)
        quantity = F.when(first_part, F.col("ordered_quantity")
                          * F.when(F.col("so_id") % 17 == 0, 2).otherwise(1)
                          ).otherwise(F.col("shipped_quantity"))
        lines = self._sold.filter(first_part | (F.col("shipped_quantity") > 0)).select(
            (F.col("so_id") * 2 + packed.cast("int")).alias("dc_id"),
            "item_id", _qty(quantity).alias("shipped_quantity"))
        return line_ids(lines, "dc_id", "item_id", "dc_line_id")

    def stock_balance(self) -> DataFrame:
        cancelled = (F.col("o_orderstatus") == "O") & (F.col("so_id") % 4 == 3)
        reserved = self._sold.filter(~cancelled).groupBy("item_id").agg(
            F.sum(F.col("ordered_quantity") - F.col("shipped_quantity")).alias("reserved"))
        return self.raw("part").select(F.col("p_partkey").alias("item_id")).join(
            reserved, "item_id", "left").select(
            "item_id",
            _qty(F.col("item_id") * 37 % 400).alias("available_quantity"),
            _qty(F.coalesce("reserved", F.lit(0))).alias("reserved_quantity"),
            _loaded("last_updated"),
        )

    # -- procurement ---------------------------------------------------------

    def _bought(self) -> DataFrame:
        """Order lines with the purchase order they belong to."""
        return self.raw("lineitem").select(
            (F.col("l_suppkey") * 10000 + (F.year("l_shipdate") - 1995) * 12
             + F.month("l_shipdate")).alias("po_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").alias("quantity"),
            "l_returnflag",
        )

    def _bought_lines(self) -> DataFrame:
        return self._bought().groupBy("po_id", "item_id").agg(
            _qty(F.sum("quantity")).alias("ordered_quantity"),
            _qty(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("quantity"))),
                            F.lit(0))).alias("received_quantity"))

    def purchase_order_lines(self) -> DataFrame:
        cost = self.raw("part").select(
            F.col("p_partkey").alias("item_id"), _qty(F.col("p_retailprice")).alias("unit_cost"))
        lines = self._bought_lines().join(cost, "item_id").select(
            "po_id", "item_id", "ordered_quantity", "received_quantity", "unit_cost")
        return with_generated(line_ids(lines, "po_id", "item_id", "po_line_id"), "purchase_order_lines")

    def purchase_orders(self) -> DataFrame:
        totals = self._bought().groupBy("po_id").agg(
            F.bool_and(F.col("l_returnflag") == "R").alias("all_in"),
            F.bool_or(F.col("l_returnflag") == "R").alias("some_in"))
        return totals.select(
            "po_id",
            F.expr("po_id div 10000").alias("supplier_id"),
            (F.col("po_id") % 25).alias("created_by"),
            F.when(F.col("all_in"), "Completed").when(F.col("some_in"), "Partially_Received")
            .when(F.col("po_id") % 11 == 0, "Cancelled").otherwise("Pending").alias("status"),
            _null("purchase_orders", "notes"),
            _loaded("created_at"), _loaded("updated_at"),
            _null("purchase_orders", "received_at"),
        )

    def _receipt_key(self) -> Column:
        return (F.col("po_id") * 2 + (F.col("l_returnflag") == "A").cast("int")).alias("grn_id")

    def goods_receipts(self) -> DataFrame:
        return (
            self._bought().filter("l_returnflag <> 'N'")
            .select(self._receipt_key(), "po_id").distinct()
            .select(
                "grn_id", "po_id", (F.col("po_id") % 25).alias("received_by"),
                F.when(F.col("grn_id") % 2 == 1, "Draft").otherwise("Confirmed").alias("status"),
                _null("goods_receipts", "notes"),
                _loaded("received_at"),
            ))

    def goods_receipt_lines(self) -> DataFrame:
        summed = (
            self._bought().filter("l_returnflag <> 'N'")
            .groupBy(self._receipt_key(), "item_id").agg(F.sum("quantity").alias("quantity")))
        over = (F.col("grn_id") % 2 == 1) & (F.expr("grn_id div 2") % 13 == 0)
        lines = summed.select(
            "grn_id", "item_id",
            _qty(F.col("quantity") * F.when(over, 3).otherwise(1)).alias("received_quantity"))
        return line_ids(lines, "grn_id", "item_id", "grn_line_id")
