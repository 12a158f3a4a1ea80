"""Running totals and prior values that do not depend on one task per key.

A window over a key puts all rows of that key into one task. Here the order column is
cut into digits instead: rows of a key that differ only in the last digit share a window,
then one row per such span stands for it, spans that differ only in the next digit share
a window, and so on. With digits of 20 bits a bigint has three full ones and a
last one of 4 bits, so no window holds more than 2^20 rows of a key, whatever gaps
the order has, and the last one 16.

The order column is a bigint that is unique within a key.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotflow.stored import durable

SPAN = 1 << 20
LEVELS = 3


def _cut(df: DataFrame, column: str, name: str, span: int) -> DataFrame:
    return df.withColumn(name, F.expr(f"`{column}` div {span}"))


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
                   span: int = SPAN, busiest: int | None = None) -> DataFrame:
    """Add for each name the total of its value over the earlier rows of the key.

    NULL values count as nothing; a first row gets zero. ``df`` is read twice, but once where no key has more
    than ``span`` rows by ``busiest``, which no key exceeds: the rows of a key are then a window without being cut.
    """
    if busiest is not None and busiest <= span:
        return df.withColumns({
            n: F.coalesce(F.sum(F.coalesce(v, F.lit(0))).over(_before(keys, order)), F.lit(0)) for n, v in values.items()
        }).dropna(subset=[*keys, order])  # a row without an order counts, but is left out
    rows = _cut(df, order, "_g1", span).withColumns(
        {f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    local = rows.withColumns(
        {f"_t0_{n}": F.sum(f"_v_{n}").over(_before([*keys, "_g1"], order)) for n in values})
    spans = rows.groupBy(*keys, "_g1").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    offsets, levels = None, []
    for level in range(1, LEVELS + 1):
        here, up = f"_g{level}", f"_g{level + 1}"
        last = level == LEVELS
        spans = spans if last else _cut(spans, here, up, span)
        shared = keys if last else [*keys, up]
        levels.append(spans.select(*shared, here, *[
            F.coalesce(F.sum(f"_s_{n}").over(_before(shared, here)), F.lit(0)).alias(f"_t{level}_{n}")
            for n in values]))
        if not last:
            spans = spans.groupBy(*keys, up).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in values])
    offsets = levels[-1]
    for level in range(LEVELS - 1, 0, -1):
        offsets = levels[level - 1].join(offsets, [*keys, f"_g{level + 1}"])
    return local.join(offsets, [*keys, "_g1"]).select(
        *df.columns,
        *[sum([F.col(f"_t{level}_{n}") for level in range(1, LEVELS + 1)],
              F.coalesce(f"_t0_{n}", F.lit(0))).alias(n) for n in values])


def prior_value(df: DataFrame, keys: list[str], order: str, value: str, name: str,
                span: int = SPAN) -> DataFrame:
    """Add ``name``: the value of the row before in the key, NULL for the first row."""
    rows = _cut(df, order, "_g1", span)
    inside = Window.partitionBy(*keys, "_g1").orderBy(order)
    local = rows.withColumns({
        "_before": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
    # A span stands for its last row; a struct tells a NULL value from no row.
    spans = rows.groupBy(*keys, "_g1").agg(F.max(order).alias("_at"),
                                           F.struct(F.max_by(value, order).alias("x")).alias("_end"))
    levels = []
    for level in range(1, LEVELS + 1):
        here, up = f"_g{level}", f"_g{level + 1}"
        last = level == LEVELS
        spans = spans if last else _cut(spans, here, up, span)
        shared = keys if last else [*keys, up]
        levels.append(spans.select(*shared, here, F.lag("_end").over(
            Window.partitionBy(*shared).orderBy(here)).alias(f"_c{level}")))
        if not last:
            spans = spans.groupBy(*keys, up).agg(F.max("_at").alias("_at"),
                                                 F.max_by("_end", "_at").alias("_end"))
    carried = levels[-1]
    for level in range(LEVELS - 1, 0, -1):
        carried = levels[level - 1].join(carried, [*keys, f"_g{level + 1}"])
    end = F.coalesce(*[f"_c{level}" for level in range(1, LEVELS + 1)])["x"]
    return local.join(carried, [*keys, "_g1"]).select(
        *df.columns, F.when(F.col("_first"), end).otherwise(F.col("_before")).alias(name))


def ranked(df: DataFrame, order: str, name: str, span: int = SPAN) -> DataFrame:
    """Number all rows 1, 2, 3 … in the order of a unique bigint column."""
    numbered = running_totals(df.withColumn("_all", F.lit(0)), ["_all"], order,
                              {name: F.lit(1).cast("bigint")}, span)
    return numbered.drop("_all").withColumn(name, F.col(name) + 1)


def line_ids(lines: DataFrame, document: str, item: str, name: str) -> DataFrame:
    """Number the lines of all documents 1, 2, 3 … in the order of document and item.

    Lines are dealt by ranges of that order and stored with their place in it, once; what is added up
    are the sizes of the ranges, one number for each task that wrote. The ids are a projection of what is
    stored, so it need not be stored again. Lines without a document count, but are left out.
    """
    dealt = lines.repartitionByRange(document, item).sortWithinPartitions(document, item)
    # an id of the range and, in 33 bits, the place in it
    placed = durable(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    sizes = dict(placed.groupBy("_range").agg(F.count("*")).collect())
    earlier = accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0))), initial=0)
    offsets = F.expr(f"array({', '.join(f'{n}L' for n in earlier)})")
    place = F.col("_at") - F.shiftleft("_range", 33)
    return placed.filter(F.col(document).isNotNull()).select(
        (offsets[F.col("_range")] + place + 1).cast("bigint").alias(name), *lines.columns)
