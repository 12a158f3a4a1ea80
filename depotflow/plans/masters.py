"""Master data: items, suppliers, customers, users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.functions.columns import is_falsy, with_defaults
from depotflow.functions.messages import DUPLICATE, message
from depotflow.operators.changes import Edit, Edits
from depotflow.plans.jobs import (
    ACCEPTED, REJECTED, UNCHANGED, Result, Tables, checked, decided, looked_up, new_rows, next_ids)
from depotflow.plans.lists import role_id_by_name
from depotflow.schemas import MODEL, QTY
from depotflow.session import durable

# table -> fields a client sets
EDITED = {
    "items": ("item_name", "description", "reorder_level", "uom_id"),
    "suppliers": ("supplier_name", "email", "phone", "address"),
    "customers": ("customer_name", "phone", "address"),
}


def new_stock(tables: Tables, items: DataFrame, as_of: str) -> DataFrame:
    """A zero row for each item that has no balance."""
    new = items.select("item_id").distinct().join(tables["stock_balance"], "item_id", "left_anti")
    return new_rows("stock_balance", with_defaults(new, "stock_balance", as_of))


def init_stock(tables: Tables, items: DataFrame, as_of: str) -> DataFrame:
    """The balances with a zero row for each item that has none."""
    return tables["stock_balance"].unionByName(new_stock(tables, items, as_of))


def upsert_master(tables: Tables, table: str, requests: DataFrame, as_of: str) -> Result:
    """Create rows (no id given) and overwrite rows by id.

    An update overwrites every editable field: one that the request does not have
    becomes NULL, the reorder level becomes zero. An update of an unknown id changes
    nothing. Of several updates of one row the last sound one stays.
    """
    key = MODEL[table].key[0]
    fields = EDITED[table]
    model = {c.name: c for c in MODEL[table].columns}
    rows = requests.withColumns({
        f: F.lit(0).cast(QTY) if f == "reorder_level" else F.lit(None).cast(model[f].dtype)
        for f in fields if f not in requests.columns})
    known = tables[table].select(F.col(key), F.lit(True).alias("known"))
    rows = looked_up(rows, known, key)
    rows = rows.withColumn("is_new", F.col(key).isNull()).withColumnRenamed(key, "target")
    # a create also refuses an empty name or unit, which an update lets through
    needed = [f for f in fields if f.endswith("_name") or f == "uom_id"]
    empty = F.lit(False)
    for f in needed:
        empty = empty | is_falsy(f, rows.schema[f].dataType)
    rows = checked(tables, rows, table).withColumn(
        "reject_reason",
        F.when(F.col("is_new") & empty, F.lit("required field is empty"))
        .when(F.col("is_new") | F.col("known"), F.col("reject_reason")))
    rows = durable(rows)

    new = rows.filter("is_new AND reject_reason IS NULL").drop("target")
    new = with_defaults(new, table, as_of, [n for n in MODEL[table].names if n != key])
    new = next_ids(new, tables, table)

    def overwritten(how: str) -> DataFrame:
        last = (
            rows.filter("known AND reject_reason IS NULL")
            .groupBy("target").agg(F.max_by(F.struct(*fields), "req_seq").alias("_set"))
            .withColumnRenamed("target", key))
        return tables[table].join(last, key, how).withColumns({
            f: F.when(F.col("_set").isNotNull(), F.col(f"_set.{f}")).otherwise(F.col(f))
            for f in fields}).select(*MODEL[table].names)

    changed = {table: Edit(overwritten, lambda: new_rows(table, new))}
    if table == "items":
        changed["stock_balance"] = Edit(inserted=lambda: new_stock(tables, new, as_of))
    outcome = rows.join(new.select("req_seq", key), "req_seq", "left").select(
        "req_seq", F.coalesce(key, "target").alias(key),
        F.when(F.col("reject_reason").isNotNull(), REJECTED)
        .when(F.col("is_new") | F.col("known"), ACCEPTED).otherwise(UNCHANGED).alias("outcome"),
        F.col("reject_reason").alias("reason"))
    return Result(Edits(tables, **changed), outcome)


def deactivate(tables: Tables, table: str, keys: DataFrame, how: str = "left") -> DataFrame:
    """The table with the rows of the asked keys switched off; with "inner" these rows only."""
    key = MODEL[table].key[0]
    asked = keys.select(key).distinct().withColumn("_off", F.lit(True))
    return tables[table].join(asked, key, how).withColumn(
        "is_active", F.col("is_active") & F.col("_off").isNull()).select(*MODEL[table].names)


def assign_roles(tables: Tables, requests: DataFrame, as_of: str) -> Result:
    """New users with one role each, by role name.

    ``requests``: ``req_seq``, ``username``, ``role``. An unknown role refuses the
    request before anything is written; a name is taken by its first sound request.
    """
    text = MODEL["users"].schema["username"].dataType
    empty = is_falsy("username", text) | is_falsy("role", text)
    rows = role_id_by_name(tables, requests).withColumnRenamed("reject_reason", "_role")
    taken = tables["users"].select("username", F.lit(True).alias("name_used"))
    rows = looked_up(rows, taken, "username")
    rows = checked(tables, with_defaults(rows, "users", as_of, ["is_active", "created_at"]),
                   "users")
    rows = durable(rows.withColumn(
        "reject_reason",
        F.when(empty, "required field is empty").otherwise(F.coalesce(
            "_role", "reject_reason",
            F.when(F.col("name_used"), message(DUPLICATE, F.lit("username")))))))
    first = rows.filter("reject_reason IS NULL").groupBy("username").agg(
        F.min("req_seq").alias("first_seq"))
    rows = rows.join(first, "username", "left").withColumn(
        "reject_reason",
        F.coalesce("reject_reason", F.when(
            F.col("req_seq") != F.col("first_seq"), message(DUPLICATE, F.lit("username")))))
    new = durable(next_ids(rows.filter("reject_reason IS NULL"), tables, "users"))
    outcome = decided(rows.join(new.select("req_seq", "user_id"), "req_seq", "left"),
                      "username", "user_id")
    return Result(Edits(
        tables, users=Edit(inserted=lambda: new_rows("users", new)),
        user_roles=Edit(inserted=lambda: new_rows("user_roles", new))), outcome)
