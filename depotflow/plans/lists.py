"""List and lookup queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.functions.columns import keep_nulls_list
from depotflow.functions.messages import ROLE_UNKNOWN, message
from depotflow.schemas import MODEL
from depotflow.session import durable

Tables = Mapping[str, DataFrame]


def user_roles(tables: Tables) -> DataFrame:
    """Each user with the list of role names; ``[NULL]`` for a user without roles."""
    return (
        tables["users"].join(tables["user_roles"], "user_id", "left")
        .join(tables["roles"], "role_id", "left")
        .groupBy("user_id", "username", "is_active", "created_at")
        .agg(F.sort_array(keep_nulls_list(F.col("role_name"))).alias("roles"))
        .orderBy("username"))


def user_primary_role(tables: Tables) -> DataFrame:
    """One role per user, the one with the lowest id; users without roles are left out."""
    first = tables["user_roles"].groupBy("user_id").agg(F.min("role_id").alias("role_id"))
    return (
        tables["users"].join(first, "user_id").join(tables["roles"], "role_id")
        .select("user_id", "username", "is_active", "role_name"))


def _items_with_units(tables: Tables) -> DataFrame:
    return tables["items"].join(tables["unit_of_measure"], "uom_id").select(
        *MODEL["items"].names, "uom_name", "uom_symbol")


def items_with_uom(tables: Tables) -> DataFrame:
    return _items_with_units(tables).filter("is_active").orderBy("item_name", "item_id")


def item_lookup(tables: Tables, keys: DataFrame) -> DataFrame:
    """Items by id, active or not; ``keys`` has a column ``item_id``."""
    return _items_with_units(tables).join(keys.select("item_id"), "item_id", "left_semi")


def uom_list(tables: Tables) -> DataFrame:
    return tables["unit_of_measure"].orderBy("uom_name")


def active_suppliers(tables: Tables) -> DataFrame:
    return tables["suppliers"].filter("is_active").orderBy("supplier_name", "supplier_id")


def customer_list(tables: Tables) -> DataFrame:
    return tables["customers"].orderBy("customer_name", "customer_id")


def found_rows(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` for the asked keys."""
    return source.join(keys.select(key), key, "left_semi")


def lookup_by_keys(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Hits as rows of ``source`` and misses as a bare key, told apart by ``found``.

    The distinct keys are stored first, so their size is known when they filter the source
    where it is read; one join then tells hits from misses. The source is read once.
    """
    asked = durable(keys.select(key).distinct())
    hits = found_rows(source, asked, key).withColumn("found", F.lit(True))
    return asked.join(hits, key, "left").withColumn("found", F.col("found").isNotNull()).select(*source.columns, "found")


LATEST = (
    ("purchase_orders", "po_id"),
    ("goods_receipts", "grn_id"),
    ("sales_orders", "so_id"),
    ("delivery_challans", "dc_id"),
)


def latest_key(tables: Tables, table: str) -> DataFrame:
    """The highest id of a document table; NULL when it is empty."""
    return tables[table].agg(F.max(dict(LATEST)[table]).alias("latest_id")).select(
        F.lit(table).alias("document"), "latest_id")


def latest_keys(tables: Tables) -> DataFrame:
    result = None
    for table, _ in LATEST:
        one = latest_key(tables, table)
        result = one if result is None else result.unionByName(one)
    return result


def document_status(tables: Tables, table: str, keys: DataFrame) -> DataFrame:
    key = MODEL[table].key[0]
    return found_rows(tables[table].select(key, "status"), keys, key)


def role_id_by_name(tables: Tables, requests: DataFrame) -> DataFrame:
    """Each request with the id of the role it names; unknown names carry a reason."""
    roles = tables["roles"].select(F.col("role_name").alias("role"), "role_id")
    return requests.join(roles, "role", "left").withColumn(
        "reject_reason",
        F.when(F.col("role_id").isNull(), message(ROLE_UNKNOWN, F.col("role"))))
