"""All rules of the data model in one report.

A row breaks rules by itself (nulls, ranges, status lists, lengths, generated columns), and it claims
values: the key it has, the keys it refers to, what is to be unique. All that claim a value of the same key meet in one
exchange of that key alone, ids as numbers, added up on the map side first, so a parent that most rows refer
to costs a row a task. Only the values that break a rule go back to the tables that hold such a reference.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotflow.functions.columns import LINE_PARTS
from depotflow.operators.quality import domain_fields, length_fields, null_fields, range_fields, row_key
from depotflow.schemas import MODEL, MONEY, QTY, Table
from depotflow.session import durable

HAS, UNIQUE, USES = 0, 1, 2


def generated_fields(table: Table) -> dict[str, Column]:
    """Generated columns that do not have the value they should."""
    if table.name not in LINE_PARTS:
        return {}
    done, price = LINE_PARTS[table.name]
    meant = {"pending_quantity": (F.col("ordered_quantity") - F.col(done)).try_cast(QTY),
             "line_total": (F.col("ordered_quantity") * F.col(price)).try_cast(MONEY)}
    return {field: ~F.col(field).eqNullSafe(value) for field, value in meant.items()}


ROW_RULES = {"not_null": null_fields, "check_range": range_fields, "status_domain": domain_fields,
             "varchar_length": length_fields, "generated_columns": generated_fields}


KINDS = [(t.name, ",".join(key)) for t in MODEL.values() for key in (t.key, *t.unique)]


def _numbered(name: str, key: tuple[str, ...]) -> bool:
    dtypes = {c.name: c.dtype for c in MODEL[name].columns}
    return len(key) <= 2 and all(isinstance(dtypes[c], T.LongType) for c in key)


def faults(df: DataFrame, name: str) -> DataFrame:
    """The fields that rows of a table break a rule with by themselves."""
    found = [F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field")))
             for rule, fields in ROW_RULES.items() for field, condition in fields(MODEL[name]).items()]
    return df.select(row_key(MODEL[name].key).alias("row_key"), F.explode(F.array_compact(F.array(*found))).alias("e")).select(
        "e.rule", F.lit(name).alias("table_name"), "e.field", "row_key", F.lit(1).cast("bigint").alias("rows"))


def _claim(df: DataFrame, columns: tuple[str, ...], numbered: bool, role: int) -> DataFrame:
    """What rows hold of a key: ids as numbers, anything else as text; a key with a NULL claims nothing."""
    value = ([F.col(c).cast("bigint").alias(n) for c, n in zip(columns, "ab", strict=False)] if numbered
             else [row_key(columns).alias("text")])
    return df.dropna(subset=list(columns)).select(*value, F.lit(role).alias("role"))


def claims(tables: Mapping[str, DataFrame], kind: int) -> DataFrame:
    """Who has a key and who refers to it: ``a``, and ``b`` for a pair, or ``text``, and ``role``."""
    name, fields = KINDS[kind]
    key = tuple(fields.split(","))
    numbered = _numbered(name, key)
    made = [_claim(tables[name], key, numbered, HAS if key == MODEL[name].key else UNIQUE)]
    if key == MODEL[name].key[:1]:
        made += [_claim(tables[t.name], (r.column,), numbered, USES) for t in MODEL.values() for r in t.references
                 if r.parent == name]
    return reduce(DataFrame.unionByName, made)


def _held(claimed: DataFrame, kind: int) -> DataFrame:
    """The values that break a rule: how often they are there as a key, to be unique, and referred to."""
    value = [c for c in claimed.columns if c != "role"]
    counted = claimed.groupBy(*value).agg(
        *[F.count_if(F.col("role") == role).alias(n) for role, n in ((HAS, "has"), (UNIQUE, "unique"), (USES, "uses"))])
    return counted.filter("has > 1 OR unique > 1 OR (uses > 0 AND has = 0)").select(
        F.lit(kind).alias("kind"), *[F.col(c) if c in value else F.lit(None).cast(dtype).alias(c)
                                     for c, dtype in (("a", "bigint"), ("b", "bigint"), ("text", "string"))],
        "has", "unique", "uses")


def _lost(df: DataFrame, name: str, column: str, orphans: DataFrame) -> DataFrame:
    """The rows of a table that refer to one of the ``orphans`` (``ref``)."""
    rows = df.select(F.col(column).cast(orphans.schema["ref"].dataType).alias("ref"), row_key(MODEL[name].key).alias("row_key"))
    return rows.join(orphans, "ref", "left_semi").select(
        F.lit("foreign_key").alias("rule"), F.lit(name).alias("table_name"), F.lit(column).alias("field"), "row_key",
        F.lit(1).cast("bigint").alias("rows"))


def integrity_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per broken field, value or reference of all tables.

    ``rule``, ``table_name``, ``field``, ``row_key`` (for ``unique_key`` the value) and ``rows``, how many rows hold it.
    """
    found = [faults(tables[name], name) for name in MODEL]
    held = durable(reduce(DataFrame.unionByName, [_held(claims(tables, kind), kind) for kind in range(len(KINDS))]))
    names = F.array(*[F.struct(F.lit(n).alias("table_name"), F.lit(f).alias("field")) for n, f in KINDS])
    found.append(held.filter("has > 1 OR unique > 1").withColumn("of", F.get(names, F.col("kind"))).select(
        F.lit("unique_key").alias("rule"), "of.table_name", "of.field",
        F.coalesce("text", F.concat_ws("|", "a", "b")).alias("row_key"), (F.col("has") + F.col("unique")).alias("rows")))
    # Values without a parent are stored by kind, so that few of them are known to be few and go to the rows.
    orphans = held.filter("uses > 0 AND has = 0")
    missing = {row.kind for row in orphans.select("kind").distinct().collect()}
    for kind, (parent, field) in enumerate(KINDS):
        if kind not in missing:
            continue
        ref = F.col("a" if _numbered(parent, (field,)) else "text").alias("ref")
        without = durable(orphans.filter(F.col("kind") == kind).select(ref))
        found += [_lost(tables[t.name], t.name, r.column, without) for t in MODEL.values() for r in t.references
                  if r.parent == parent]
    return reduce(DataFrame.unionByName, found)
