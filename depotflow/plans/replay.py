"""Whole scenarios: buy and receive goods, sell and ship them.

The steps are the document jobs, run one after the other on the tables the step
before left. Orders may be many; each step handles all of them at once.

A scenario is an order with its lines. It succeeds or fails as a whole: ``buy`` and ``sell`` run all of them
strictly or let single requests be refused, ``buy_each`` and ``sell_each`` keep the scenarios that succeed and
drop the others whole, as if each ran after the one before and was rolled back where it fails.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.functions.messages import SHORT_STOCK, message
from depotflow.operators.allocate import allocate
from depotflow.operators.running import SPAN
from depotflow.plans import procurement, sales
from depotflow.plans.jobs import ACCEPTED, REJECTED, After, Changes, Result, Tables
from depotflow.schemas import QTY
from depotflow.stored import durable

LAST_LINE = (1 << 62) - 1  # the place of what happens after the lines


class ScenarioFailed(RuntimeError):
    """A request of a strict scenario was refused; its changes are not returned."""


class _Run:
    """The tables as they are after the steps so far.

    A changed table is written when a later step first reads it, so every step starts
    from stored tables and tables that nobody reads are never made.
    """

    def __init__(self, tables: Tables, strict: bool, watch: bool = False) -> None:
        self.tables, self.strict, self.watch = tables, strict, watch
        self.refused: list[DataFrame] = []

    def step(self, name: str, result: Result, owners: DataFrame, wanted: bool = False) -> DataFrame | None:
        """Take over the changes; returns the stored outcome where it is ``wanted``.

        ``owners`` (``req_seq``, ``order_seq``, ``line_no``) tells whose the requests are. When watching,
        the refused ones are kept: ``order_seq``, ``step``, ``line_no``, ``at``, ``reason``.
        """
        outcome = durable(result.outcome) if wanted or self.strict or self.watch else None
        if self.strict and "reason" in outcome.columns:
            refused = outcome.filter(F.col("outcome") == REJECTED).select("reason").head()
            if refused is not None:
                raise ScenarioFailed(f"{name} failed and rolled back: {refused.reason}")
        if self.watch and "reason" in outcome.columns:
            self.refused.append(
                outcome.filter(F.col("outcome") == REJECTED).join(owners, "req_seq").select(
                    "order_seq", F.lit(name).alias("step"), "line_no", F.lit(len(self.refused)).alias("at"), "reason"))
        self.tables = After(self.tables, Changes(**{
            table: lambda table=table: durable(result.changed[table])
            for table in result.changed}))
        return outcome


def _of_orders(orders: DataFrame) -> DataFrame:
    return orders.select("req_seq", F.col("req_seq").alias("order_seq"), F.lit(0).cast("bigint").alias("line_no"))


def _of_lines(lines: DataFrame) -> DataFrame:
    return lines.select("req_seq", "order_seq", F.col("req_seq").alias("line_no"))


def _buy(run: _Run, orders: DataFrame, lines: DataFrame, as_of: str) -> None:
    headers, parts = _of_orders(orders), _of_lines(lines)
    made = run.step("create", procurement.create_documents(
        run.tables, "purchase_orders", orders, as_of), headers, wanted=True).select(
        F.col("req_seq").alias("order_seq"), "po_id")
    lines = lines.join(made.dropna(), "order_seq")
    run.step("lines", procurement.add_lines(
        run.tables, "purchase_order_lines", lines.drop("order_seq")), parts)
    receipts = orders.select(
        "req_seq", F.col("created_by").alias("received_by")).join(
        made.dropna().withColumnRenamed("order_seq", "req_seq"), "req_seq")
    received = run.step("receipts", procurement.create_documents(
        run.tables, "goods_receipts", receipts, as_of), headers, wanted=True).select(
        "req_seq", "grn_id").dropna()
    run.step("receipt lines", procurement.add_lines(
        run.tables, "goods_receipt_lines",
        lines.select("req_seq", "order_seq", "item_id", "quantity").join(
            received.withColumnRenamed("req_seq", "order_seq"), "order_seq").drop("order_seq")), parts)
    run.step("confirm", procurement.confirm_grn(run.tables, received, as_of), headers)


def _sell(run: _Run, orders: DataFrame, lines: DataFrame, as_of: str) -> None:
    headers, parts = _of_orders(orders), _of_lines(lines)
    carriers = [c for c in ("driver_name", "vehicle_number") if c in orders.columns]
    made = run.step("create", procurement.create_documents(
        run.tables, "sales_orders", orders.drop(*carriers), as_of), headers, wanted=True).select(
        "req_seq", "so_id").dropna()
    lines = lines.join(made.withColumnRenamed("req_seq", "order_seq"), "order_seq")
    reserved = run.step("reserve", sales.reserve_stock(
        run.tables, lines.drop("order_seq"), as_of), parts, wanted=True).filter("outcome = 'accepted'")
    for _ in range(2):
        run.step("advance", sales.advance_so(run.tables, made, as_of), headers)
    packed = orders.select("req_seq", "created_by", *carriers).join(made, "req_seq")
    sent = run.step("challans", sales.create_dc(run.tables, packed, as_of), headers, wanted=True).select(
        "so_id", "req_seq", "dc_id").dropna()
    loaded = reserved.select("req_seq", "so_id", "item_id").join(
        lines.select("req_seq", "quantity"), "req_seq").join(sent.select("so_id", "dc_id"), "so_id")
    run.step("challan lines", procurement.add_lines(
        run.tables, "delivery_challan_lines",
        loaded.select("req_seq", "dc_id", "item_id", "quantity")), parts)
    dispatch = sent.select("req_seq", "dc_id")
    run.step("dispatch", sales.dispatch_dc(run.tables, dispatch, as_of), headers)
    run.step("deliver", sales.deliver_dc(run.tables, dispatch, as_of), headers)


def buy(tables: Tables, orders: DataFrame, lines: DataFrame, as_of: str,
        strict: bool = True) -> Tables:
    """Order goods, receive each order in full and confirm the receipts.

    ``orders``: ``req_seq``, ``supplier_id``, ``created_by``. ``lines``: ``req_seq``,
    ``order_seq`` (the order's ``req_seq``), ``item_id``, ``quantity``, ``unit_cost``.
    """
    run = _Run(tables, strict)
    _buy(run, orders, lines, as_of)
    return run.tables


def sell(tables: Tables, orders: DataFrame, lines: DataFrame, as_of: str,
         strict: bool = True) -> Tables:
    """Take orders, reserve, pack, dispatch all that was reserved, and deliver.

    ``orders``: ``req_seq``, ``customer_id``, ``created_by`` and, if given,
    ``driver_name`` and ``vehicle_number``. ``lines``: ``req_seq``, ``order_seq``,
    ``item_id``, ``quantity``, ``unit_price``.
    """
    run = _Run(tables, strict)
    _sell(run, orders, lines, as_of)
    return run.tables


def _own_faults(tables: Tables, orders: DataFrame, lines: DataFrame, as_of: str,
                play: Callable[..., None]) -> DataFrame:
    """The first fault of each scenario that it has by itself, whatever the others do.

    All scenarios are tried at once on tables without stock rows, where nothing can run short; what
    that leaves behind is dropped.
    """
    trial = _Run(After(tables, {"stock_balance": tables["stock_balance"].filter("false")}), False, watch=True)
    play(trial, orders, lines, as_of)
    faults = reduce(DataFrame.unionByName, trial.refused)
    first = faults.groupBy("order_seq").agg(F.min_by(
        F.struct("step", "line_no", "reason"), F.struct("at", "line_no")).alias("f"))
    return durable(first.select("order_seq", "f.*"))


def _judged(orders: DataFrame, failed: DataFrame) -> DataFrame:
    """An outcome for each scenario from the failed ones (``order_seq``, ``step``, ``reason``)."""
    return durable(orders.select(F.col("req_seq").alias("order_seq")).join(failed, "order_seq", "left").select(
        "order_seq", F.when(F.col("step").isNull(), ACCEPTED).otherwise(REJECTED).alias("outcome"), "step", "reason"))


def _kept(run: _Run, orders: DataFrame, lines: DataFrame, as_of: str, outcome: DataFrame,
          play: Callable[..., None]) -> Tables:
    """The tables after the scenarios that succeed; a request that is refused now is an error of ours."""
    good = outcome.filter(F.col("outcome") == ACCEPTED).select("order_seq")
    play(run, durable(orders.join(good.withColumnRenamed("order_seq", "req_seq"), "req_seq", "left_semi")),
         durable(lines.join(good, "order_seq", "left_semi")), as_of)
    return run.tables


def buy_each(tables: Tables, orders: DataFrame, lines: DataFrame, as_of: str) -> tuple[Tables, DataFrame]:
    """``buy`` with scenarios that fail dropped whole: the tables, and ``order_seq``, ``outcome``, ``step``, ``reason``.

    Each buys and receives on an order of its own, so no scenario depends on another.
    """
    faults = _own_faults(tables, orders, lines, as_of, _buy)
    outcome = _judged(orders, faults.select("order_seq", "step", "reason"))
    return _kept(_Run(tables, True), orders, lines, as_of, outcome, _buy), outcome


def sell_each(tables: Tables, orders: DataFrame, lines: DataFrame, as_of: str,
              span: int = SPAN) -> tuple[Tables, DataFrame]:
    """``sell`` with scenarios that fail dropped whole: the tables, and ``order_seq``, ``outcome``, ``step``, ``reason``.

    Scenarios compete for the available stock of items, all their lines or none. A fault of a scenario's own
    counts as a line that nothing can serve, at its place among the lines, so the first fault of either kind is told.
    """
    faults = _own_faults(tables, orders, lines, as_of, _sell)
    early = faults.filter("step = 'create'")
    later = faults.filter("step <> 'create'").withColumn(
        "line_no", F.when(F.col("step") == "reserve", F.col("line_no")).otherwise(LAST_LINE))
    docs = orders.select(F.col("req_seq").alias("doc")).join(early.withColumnRenamed("order_seq", "doc"), "doc", "left_anti")
    stock = tables["stock_balance"].select("item_id", F.col("available_quantity").alias("free"))
    wanted = (lines.withColumnRenamed("order_seq", "doc").join(docs, "doc", "left_semi")
              .join(later.select(F.col("order_seq").alias("doc"), F.col("line_no").alias("stop")), "doc", "left")
              .filter(F.col("stop").isNull() | (F.col("req_seq") < F.col("stop")))
              .join(stock, "item_id", "left")
              .select("doc", F.lit("stock").alias("kind"), "item_id", F.col("quantity").cast(QTY).alias("need"), "free",
                      F.col("req_seq").alias("line_no")))
    rule = later.select(F.col("order_seq").alias("doc"), F.lit("rule").alias("kind"),
                        F.col("order_seq").alias("item_id"), F.lit(1).cast(QTY).alias("need"),
                        F.lit(0).cast(QTY).alias("free"), "line_no")
    needs = durable(wanted.unionByName(rule))
    queue = allocate(docs, needs, ["kind", "item_id"], span)
    short = queue.failed(left=True).withColumnRenamed("doc", "order_seq")
    told = (short.join(later.select("order_seq", "step", F.col("reason").alias("own")), "order_seq", "left").select(
        "order_seq", F.when(F.col("kind") == "rule", F.col("step")).otherwise("reserve").alias("step"),
        F.when(F.col("kind") == "rule", F.col("own")).otherwise(message(
            SHORT_STOCK, F.col("item_id"), F.col("left").cast(QTY), F.col("need"))).alias("reason")))
    outcome = _judged(orders, told.unionByName(early.select("order_seq", "step", "reason")))
    return _kept(_Run(tables, True), orders, lines, as_of, outcome, _sell), outcome
