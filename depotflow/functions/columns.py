"""Column expressions used by the views, jobs and checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotflow.schemas import MODEL, MONEY, QTY, STAMP

def stamp(text: str) -> Column:
    """One fixed batch time; jobs never read the clock per row."""
    return F.lit(text).cast(STAMP)


def on_hand(available: Column, reserved: Column) -> Column:
    return (available + reserved).cast(T.DecimalType(13, 2))


def is_low(available: Column, reorder_level: Column) -> Column:
    return F.when(available <= reorder_level, True).otherwise(False)


def pending(ordered: Column, done: Column) -> Column:
    return (ordered - done).cast(QTY)


def line_total(quantity: Column, price: Column) -> Column:
    return (quantity * price).cast(MONEY)


# table -> (quantity already handled, price)
LINE_PARTS = {
    "purchase_order_lines": ("received_quantity", "unit_cost"),
    "sales_order_lines": ("shipped_quantity", "unit_price"),
}


def with_generated(df: DataFrame, table: str) -> DataFrame:
    """Compute the generated columns of an order line table, in model order."""
    done, price = LINE_PARTS[table]
    return df.withColumns({
        "pending_quantity": pending(F.col("ordered_quantity"), F.col(done)),
        "line_total": line_total(F.col("ordered_quantity"), F.col(price)),
    }).select(*MODEL[table].names)


def with_defaults(df: DataFrame, table: str, as_of: str, fields: list[str] | None = None) -> DataFrame:
    """Add the default of each column that ``df`` does not have.

    A column that is present keeps its NULLs: the default stands for an absent
    field only. Columns without a default become NULL.
    """
    added = {}
    for column in MODEL[table].stored:
        if column.name in df.columns or (fields is not None and column.name not in fields):
            continue
        if column.default == "as_of":
            added[column.name] = stamp(as_of)
        else:
            added[column.name] = F.expr(column.default or "NULL").cast(column.dtype)
    return df.withColumns(added) if added else df


def is_falsy(column: str, dtype: T.DataType) -> Column:
    """Absent, NULL, zero, false or empty."""
    value = F.col(column)
    if isinstance(dtype, T.StringType):
        empty = value == ""
    elif isinstance(dtype, T.BooleanType):
        empty = ~value
    else:
        empty = value == 0
    return value.isNull() | empty


def choose(value: Column, options: Mapping[str, str]) -> Column:
    """Simple CASE: the option for ``value``, NULL when there is none."""
    result: Column | None = None
    for when, then in options.items():
        result = F.when(value == when, then) if result is None else result.when(value == when, then)
    return result


def keep_nulls_list(value: Column) -> Column:
    """Collect values into a list that keeps NULL entries.

    ``collect_list`` drops NULLs; wrapping each value in a struct keeps them.
    """
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s["v"])
