"""Integrity rules as data-quality operators.

The row rules of a table are tested together in one pass: each row yields an array
of the fields that break a rule, and only failing rows leave the scan. A report
has one row per broken field: ``rule``, ``table_name``, ``field``, ``row_key``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotflow.functions.columns import LINE_PARTS, is_falsy
from depotflow.operators.changes import Edit, Edits
from depotflow.schemas import MODEL, MONEY, QTY, Table
from depotflow.stored import durable

Tables = Mapping[str, DataFrame]


def row_key(columns: tuple[str, ...] | list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _report(df: DataFrame, rule: str, table: Table, broken: dict[str, Column]) -> DataFrame:
    """One row per (row, field) whose condition is true."""
    present = {f: c for f, c in broken.items() if f in df.columns}
    if not present:
        return df.sparkSession.createDataFrame(
            [], "rule string, table_name string, field string, row_key string")
    fields = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in present.items()]))
    return df.select(row_key(table.key).alias("row_key"), F.explode(fields).alias("field")).select(
        F.lit(rule).alias("rule"), F.lit(table.name).alias("table_name"), "field", "row_key")


def null_fields(table: Table) -> dict[str, Column]:
    return {c: F.col(c).isNull() for c in table.required}


def range_fields(table: Table) -> dict[str, Column]:
    # NULL passes a check: only a condition that is false is broken
    return {c: ~F.expr(condition) for c, condition in table.ranges}


def domain_fields(table: Table) -> dict[str, Column]:
    return {c: ~F.col(c).isin(*allowed) for c, allowed in table.domains}


def length_fields(table: Table) -> dict[str, Column]:
    return {c.name: F.length(c.name) > c.max_length for c in table.columns if c.max_length}


def not_null(df: DataFrame, table: str) -> DataFrame:
    return _report(df, "not_null", MODEL[table], null_fields(MODEL[table]))


def check_range(df: DataFrame, table: str) -> DataFrame:
    return _report(df, "check_range", MODEL[table], range_fields(MODEL[table]))


def status_domain(df: DataFrame, table: str) -> DataFrame:
    return _report(df, "status_domain", MODEL[table], domain_fields(MODEL[table]))


def varchar_length(df: DataFrame, table: str) -> DataFrame:
    return _report(df, "varchar_length", MODEL[table], length_fields(MODEL[table]))


def row_reason(df: DataFrame, table: str) -> Column:
    """The first broken row rule as text, NULL for a sound row."""
    model = MODEL[table]
    rules = (("not_null", null_fields(model)), ("check_range", range_fields(model)),
             ("status_domain", domain_fields(model)), ("varchar_length", length_fields(model)))
    return F.coalesce(*[
        F.when(condition, F.lit(f"{rule} {field}"))
        for rule, fields in rules for field, condition in fields.items() if field in df.columns
    ], F.lit(None).cast("string"))


def split(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the row rules; the rejected rows carry ``reject_reason``."""
    marked = df.withColumn("reject_reason", row_reason(df, table))
    return (marked.filter("reject_reason IS NULL").drop("reject_reason"),
            marked.filter("reject_reason IS NOT NULL"))


def unique_key(df: DataFrame, table: str) -> DataFrame:
    """Key values held by more than one row; keys with a NULL do not collide.

    Counted with partial aggregation, so a value that holds a large share of the
    rows is one row per map task in the shuffle.
    """
    model = MODEL[table]
    result = None
    for key in (model.key, *model.unique):
        if not set(key) <= set(df.columns):
            continue
        found = (
            df.select(*key).dropna().groupBy(*key).agg(F.count("*").alias("rows"))
            .filter("rows > 1")
            .select(F.lit("unique_key").alias("rule"), F.lit(table).alias("table_name"),
                    F.lit(",".join(key)).alias("field"), row_key(key).alias("row_key"), "rows"))
        result = found if result is None else result.unionByName(found)
    return result


def foreign_key(tables: Tables, df: DataFrame, table: str) -> DataFrame:
    """Rows whose reference has no parent; a NULL reference passes.

    References are reduced to distinct values before they meet the parent, so a
    parent that most rows point to costs one row; only the orphan values go back
    to find their rows.
    """
    model = MODEL[table]
    result = None
    for reference in model.references:
        if reference.column not in df.columns:
            continue
        parent_key = MODEL[reference.parent].key[0]
        parents = tables[reference.parent].select(F.col(parent_key).alias("ref"))
        used = df.select(F.col(reference.column).alias("ref")).dropna().distinct()
        orphans = used.join(parents, "ref", "left_anti")
        found = df.join(orphans, df[reference.column] == orphans["ref"], "left_semi").select(
            F.lit("foreign_key").alias("rule"), F.lit(table).alias("table_name"),
            F.lit(reference.column).alias("field"), row_key(model.key).alias("row_key"))
        result = found if result is None else result.unionByName(found)
    return result


# a batch of more rows is not looked up but joined as a whole
FEW = 1 << 18


def rows_for(table: DataFrame, batch: DataFrame, on: list[str], many: bool = False) -> DataFrame:
    """The rows of a table that a batch of requests is about.

    A batch is mostly small against the table it looks up. The distinct keys of a
    small batch are broadcast, so the table is filtered where it is read and not
    shuffled as a whole; for a large one this is a plain semi join on the same key. Where a join by a longer
    key follows and the batch is known to have ``many`` rows, the table is left whole: it would be dealt twice.
    """
    return table if many else table.join(batch.select(*on).distinct(), on, "left_semi")


def orphan_flags(tables: Tables, df: DataFrame, table: str) -> DataFrame:
    """``df`` with ``orphan``: the first reference column without a parent, or NULL.

    Distinct references meet the parents; only those without one, which are stored and mostly few, go
    back to the rows, so the rows are not dealt. A row comes once for each parent of its reference.
    """
    flags, rows = [], df
    for i, reference in enumerate(MODEL[table].references):
        column = reference.column
        if column not in rows.columns:
            continue
        parents = tables[reference.parent].select(F.col(MODEL[reference.parent].key[0]).alias(column))
        used = rows.select(column).dropna().distinct()
        found = rows_for(parents, used, [column]).groupBy(column).agg(F.count("*").alias("_n"))
        odd = durable(used.join(found, column, "left").filter("_n IS NULL OR _n > 1").select(
            column, F.col("_n").isNull().alias(f"_lost_{i}"),
            F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))).alias("_copy")).drop("_copy"))
        df = df.join(odd, column, "left")
        flags.append((i, column))
    orphan = F.coalesce(*[F.when(F.col(f"_lost_{i}"), F.lit(c)) for i, c in flags], F.lit(None).cast("string"))
    return df.withColumn("orphan", orphan).drop(*[f"_lost_{i}" for i, _ in flags])


def cascade_delete(tables: Tables, table: str, keys: DataFrame) -> tuple[Edits, DataFrame]:
    """Delete rows of ``table`` by key, each key on its own.

    A key is blocked while a row of a table without cascade points to it. Returns
    the tables that change and one outcome row per asked key.
    """
    key = MODEL[table].key[0]
    asked = keys.select(F.col(key)).distinct()
    outcome = asked.join(tables[table].select(key, F.lit(True).alias("known")), key, "left")
    blocked = None
    children = [(t.name, r) for t in MODEL.values() for r in t.references if r.parent == table]
    for child, reference in children:
        if reference.cascade:
            continue
        users = tables[child].select(
            F.col(reference.column).alias(key), F.lit(child).alias("blocked_by"))
        users = users.join(asked, key, "left_semi").distinct()
        blocked = users if blocked is None else blocked.unionByName(users)
    if blocked is not None:
        outcome = outcome.join(
            blocked.groupBy(key).agg(F.min("blocked_by").alias("blocked_by")), key, "left")
    else:
        outcome = outcome.withColumn("blocked_by", F.lit(None).cast("string"))
    outcome = outcome.select(
        key,
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("blocked_by").isNotNull(), "blocked").otherwise("deleted").alias("outcome"),
        F.when(F.col("known"), F.col("blocked_by")).alias("blocked_by"))
    gone = outcome.filter("outcome = 'deleted'").select(F.col(key).alias("gone"))

    def without(name: str, column: str) -> Edit:
        return Edit(left=lambda how: tables[name].join(
            gone.withColumnRenamed("gone", column), column, how).select(*MODEL[name].names))

    return Edits(tables, **{table: without(table, key)}, **{
        child: without(child, r.column) for child, r in children if r.cascade}), outcome


# --- fixed values: fields a request must give, with a value that is not empty ---
REQUIRED_FIELDS = {
    "create_customer": ("customer_name",),
    "create_supplier": ("supplier_name",),
    "create_item": ("item_name", "uom_id"),
    "create_user": ("username", "password", "role"),
    "change_password": ("password",),
    "create_purchase_order": ("supplier_id",),
    "create_goods_receipt": ("po_id",),
    "create_sales_order": ("customer_id",),
    "create_delivery_challan": ("so_id",),
    "add_line": ("item_id", "quantity"),
}


def required_fields(df: DataFrame, request: str, key: str) -> DataFrame:
    """Required fields of each request that are absent, NULL, zero or empty."""
    absent = [
        F.lit(f) if f not in df.columns
        else F.when(is_falsy(f, df.schema[f].dataType), F.lit(f))
        for f in REQUIRED_FIELDS[request]
    ]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*absent))).alias("field"))


def generated_columns(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their generated columns, rows whose generated columns overflow)."""
    done, price = LINE_PARTS[table]
    left = F.col("ordered_quantity") - F.col(done)
    total = F.col("ordered_quantity") * F.col(price)
    computed = df.withColumns({
        "pending_quantity": left.try_cast(QTY),
        "line_total": total.try_cast(MONEY),
    })
    overflow = ((left.isNotNull() & F.col("pending_quantity").isNull())
                | (total.isNotNull() & F.col("line_total").isNull()))
    sound = computed.filter(~overflow).select(*MODEL[table].names)
    return sound, computed.filter(overflow).drop("pending_quantity", "line_total")
