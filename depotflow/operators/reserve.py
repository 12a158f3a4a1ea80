"""Greedy reservation: each request takes its quantity if enough is left.

A refused request takes nothing, so later smaller ones may pass, and a plain
running sum gives wrong answers. Items with a moderate number of requests are
folded in order, one pass per partition with constant memory. Items with more
requests than that are settled in bands instead, so that no task has to hold or
walk the queue of one item:

While between ``2^k`` and ``2^(k+1)`` is left of an item, a request below ``2^k``
always passes, one of ``2^(k+1)`` or more never does, and the first one between
them that passes ends the band, as does a small one that takes the rest below
``2^k``. A running total finds that point for all items at once. What is left at
least halves with each round, so 12 digits take at most 41 rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotflow.operators.running import SPAN, running_totals
from depotflow.schemas import QTY
from depotflow.stored import durable

FOLD_LIMIT = 1_000_000

ACCEPTED, SHORT, DUPLICATE = "accepted", "short", "duplicate"


def reserve(requests: DataFrame, fold_limit: int = FOLD_LIMIT, span: int = SPAN) -> DataFrame:
    """Decide requests.

    ``requests``: ``item_id``, ``req_seq`` (unique bigint, the arrival order),
    ``pair`` (bigint; one accepted request per item and pair), ``qty`` (> 0) and
    ``free`` (what the item has at the start; NULL means it keeps no stock and
    accepts everything). Returns ``req_seq``, ``verdict`` and ``available``, what was
    left when the request came; a copy of a taken pair is not measured and has NULL.
    ``requests`` is read several times and should be stored.
    """
    requests = requests.select("item_id", "req_seq", "pair", "qty", "free")
    sizes = requests.groupBy("item_id").agg(F.count("*").alias("n"))
    long_queues = durable(sizes.filter(F.col("n") > fold_limit).select("item_id"))
    if long_queues.isEmpty():
        return _folded(requests)
    return _folded(requests.join(long_queues, "item_id", "left_anti")).unionByName(
        _banded(requests.join(long_queues, "item_id", "left_semi"), span))


# -- moderate queues ------------------------------------------------------------


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by item and arrival; carry one number from row to row."""
    item, left, taken = None, None, set()
    for batch in batches:
        verdicts, available = [], []
        for next_item, pair, repeated, cents, free in zip(
                *(batch.column(c).to_pylist()
                  for c in ("item_id", "pair", "repeated", "cents", "free_cents"))):
            if next_item != item:
                item, left, taken = next_item, free, set()
            available.append(None if repeated and pair in taken else left)
            if repeated and pair in taken:
                verdicts.append(DUPLICATE)
            elif left is not None and left < cents:
                verdicts.append(SHORT)
            else:
                verdicts.append(ACCEPTED)
                if repeated:
                    taken.add(pair)
                if left is not None:
                    left -= cents
        yield pa.RecordBatch.from_arrays(
            [batch.column("req_seq"), pa.array(verdicts, pa.string()),
             pa.array(available, pa.int64())], ["req_seq", "verdict", "cents"])


def _folded(requests: DataFrame) -> DataFrame:
    same = Window.partitionBy("item_id", "pair")
    queued = (
        requests.repartition("item_id")
        .withColumn("repeated", F.count("*").over(same) > 1)
        .select("item_id", "req_seq", "pair", "repeated",
                (F.col("qty") * 100).cast("bigint").alias("cents"),
                (F.col("free") * 100).cast("bigint").alias("free_cents"))
        .sortWithinPartitions("item_id", "req_seq"))
    walked = queued.mapInArrow(_walk, "req_seq bigint, verdict string, cents bigint")
    return walked.select("req_seq", "verdict", _quantity(F.col("cents")).alias("available"))


def _quantity(cents):
    return (cents * F.expr("0.01BD")).cast(QTY)


# -- long queues ------------------------------------------------------------------


def _banded(requests: DataFrame, span: int) -> DataFrame:
    pairs = requests.groupBy("item_id", "pair").agg(
        F.count("*").alias("n"), F.min("req_seq").alias("first_of_pair"))
    pairs = pairs.filter("n > 1").drop("n")
    rows = durable(
        requests.join(pairs, ["item_id", "pair"], "left")
        .withColumn("repeated", F.col("first_of_pair").isNotNull()))
    unlimited = rows.filter("free IS NULL").select(
        "req_seq",
        F.when(F.col("repeated") & (F.col("req_seq") > F.col("first_of_pair")), DUPLICATE)
        .otherwise(ACCEPTED).alias("verdict"),
        F.col("free").alias("available"))
    settled = [unlimited]
    waiting = rows.filter("free IS NOT NULL").drop("first_of_pair")
    some_repeat = not waiting.filter("repeated").isEmpty()

    while not waiting.isEmpty():
        marked = durable(_next_band(waiting, some_repeat, span))
        settled.append(marked.filter("verdict IS NOT NULL").select(
            "req_seq", "verdict", "available"))
        waiting = marked.filter("verdict IS NULL").select(
            "item_id", "req_seq", "pair", "qty", F.col("left").alias("free"), "repeated")
        if some_repeat:
            # the later copies of a pair that was just accepted are out
            held = marked.filter(F.col("repeated") & (F.col("verdict") == ACCEPTED)).select(
                "item_id", "pair").distinct()
            settled.append(waiting.join(held, ["item_id", "pair"], "left_semi").select(
                "req_seq", F.lit(DUPLICATE).alias("verdict"),
                F.lit(None).cast(QTY).alias("available")))
            waiting = durable(waiting.join(held, ["item_id", "pair"], "left_anti"))
    return reduce(DataFrame.unionByName, settled)


def _next_band(waiting: DataFrame, some_repeat: bool, span: int) -> DataFrame:
    """Settle the requests of the present band of each item.

    Adds ``verdict`` (NULL beyond the end of the band), ``available`` and ``left``,
    what the item has after the band.
    """
    floor = F.expr("CASE WHEN free > 0 THEN shiftleft(1L, length(bin(CAST(free * 100 AS BIGINT)))"
                   " - 1) ELSE 0L END")
    rows = waiting.withColumn("floor", _quantity(floor)).withColumn(
        "small", F.col("qty") < F.col("floor"))
    if some_repeat:
        firsts = rows.filter("repeated AND small").groupBy("item_id", "pair").agg(
            F.min("req_seq").alias("first_small"))
        rows = rows.join(firsts, ["item_id", "pair"], "left")
    else:
        rows = rows.withColumn("first_small", F.lit(None).cast("bigint"))
    rows = rows.withColumns({
        "counted": F.expr("small AND (NOT repeated OR req_seq = first_small)"),
        "blocked": F.expr("repeated AND coalesce(req_seq > first_small, false)"),
    })
    flows = running_totals(rows, ["item_id"], "req_seq",
                           {"used": F.when(F.col("counted"), F.col("qty"))}, span)
    ends = flows.filter(
        "(counted AND free - used - qty < floor)"
        " OR (NOT small AND NOT blocked AND qty + used <= free)"
    ).groupBy("item_id").agg(
        F.min("req_seq").alias("stop"),
        F.min_by(F.expr("free - used - qty"), "req_seq").cast(QTY).alias("left"))
    return flows.join(ends, "item_id", "left").select(
        "item_id", "req_seq", "pair", "qty", "repeated", "left",
        F.expr(f"""CASE WHEN req_seq > stop THEN NULL WHEN req_seq = stop THEN '{ACCEPTED}'
                   WHEN blocked THEN '{DUPLICATE}' WHEN counted THEN '{ACCEPTED}'
                   ELSE '{SHORT}' END""").alias("verdict"),
        F.when(~F.col("blocked"), F.col("free") - F.col("used")).cast(QTY).alias("available"))
