"""The selling side: reserve, advance, ship, deliver, cancel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotflow.functions.columns import choose, with_defaults, with_generated
from depotflow.functions.messages import (
    DUPLICATE, OVER_SHIPMENT, RESERVED_BELOW_ZERO, SHORT_STOCK, SO_NOT_ADVANCED,
    SO_NOT_CANCELLED, SO_NOT_PACKED, SO_UNKNOWN, message)
from depotflow.operators import reserve as reservation
from depotflow.operators.allocate import allocate
from depotflow.operators.changes import Edit, Edits
from depotflow.operators.quality import FEW, rows_for
from depotflow.operators.running import SPAN
from depotflow.plans.jobs import (
    ACCEPTED, REJECTED, UNCHANGED, Result, Tables, checked, decided, first_requests,
    is_free_pair, looked_up, move_stock, new_rows, next_ids, stamped, taken_ids, turns_of)
from depotflow.plans.procurement import line_rows
from depotflow.schemas import MODEL, QTY
from depotflow.stored import durable

# --- fixed values: the step each status can be moved by hand ---
NEXT_STATUS = {"Pending": "Processing", "Processing": "Packed"}
CLOSED_STATUS = ("Shipped", "Delivered", "Cancelled")


def reserve_stock(tables: Tables, requests: DataFrame, as_of: str,
                  fold_limit: int = reservation.FOLD_LIMIT, span: int = SPAN) -> Result:
    """New sales order lines, each of which reserves its quantity.

    ``requests``: ``req_seq``, ``so_id``, ``item_id``, ``quantity`` and, if it is not
    zero, ``unit_price``. A line is refused if less is available at its turn. An item
    without a stock row accepts the line and nothing moves; ``no_stock_row`` tells.
    """
    rows = checked(tables, line_rows(requests, "sales_order_lines"), "sales_order_lines")
    rows = is_free_pair(rows, tables, "sales_order_lines", ("so_id", "item_id"))
    duplicate = message(DUPLICATE, F.lit("so_id, item_id"))
    rows = rows.withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(F.col("pair_used"), duplicate)))
    stock = tables["stock_balance"]
    rows = durable(rows.join(
        stock.select("item_id", F.col("available_quantity").alias("free")), "item_id", "left"))
    verdict = durable(reservation.reserve(
        rows.filter("reject_reason IS NULL").select(
            "item_id", "req_seq", F.col("so_id").alias("pair"),
            F.col("ordered_quantity").alias("qty"), "free"),
        fold_limit, span))
    rows = rows.join(verdict, "req_seq", "left").withColumn(
        "reject_reason",
        F.coalesce(
            "reject_reason",
            F.when(F.col("verdict") == reservation.SHORT, message(
                SHORT_STOCK, F.col("item_id"), F.col("available"), F.col("ordered_quantity")))
            .when(F.col("verdict") == reservation.DUPLICATE, duplicate)))
    taken = rows.filter("reject_reason IS NULL")
    quantity = F.col("ordered_quantity")

    def lines() -> DataFrame:
        """The accepted lines, stored as numbering reads them several times."""
        kept = [c for c in MODEL["sales_order_lines"].names if c in taken.columns]
        return new_rows("sales_order_lines", next_ids(durable(taken.select("req_seq", *kept)), tables, "sales_order_lines"))

    outcome = decided(
        rows.withColumn("no_stock_row", F.col("reject_reason").isNull() & F.col("free").isNull()),
        "so_id", "item_id", "no_stock_row")
    return Result(Edits(
        tables, sales_order_lines=Edit(inserted=lines),
        stock_balance=Edit(lambda how: move_stock(stock, taken.select(
            "item_id", (-quantity).alias("available"), quantity.alias("reserved")), as_of, how)),
    ), outcome)


def create_dc(tables: Tables, requests: DataFrame, as_of: str) -> Result:
    """New challans for packed orders.

    ``requests``: ``req_seq``, ``so_id``, ``created_by`` and, if given, ``driver_name``
    and ``vehicle_number``, which are empty when absent. Ids are given by the caller
    or follow the highest one; a taken one refuses the request.
    """
    for field in ("driver_name", "vehicle_number"):
        if field not in requests.columns:
            requests = requests.withColumn(field, F.lit(""))
    status = tables["sales_orders"].select("so_id", F.col("status").alias("so_status"))
    rows = looked_up(requests, status, "so_id")
    guard = (
        F.when(F.col("so_status").isNull(), message(SO_UNKNOWN, F.col("so_id")))
        .when(F.col("so_status") != "Packed",
              message(SO_NOT_PACKED, F.col("so_id"), F.col("so_status"))))
    fields = [f for f in MODEL["delivery_challans"].names if f != "dc_id"]
    rows = with_defaults(rows.withColumn("_guard", guard), "delivery_challans", as_of, fields)
    rows = checked(tables, rows, "delivery_challans").withColumn(
        "reject_reason", F.coalesce("_guard", "reject_reason"))
    rows = durable(rows)
    if "dc_id" in rows.columns:
        rows = durable(taken_ids(tables, rows, "delivery_challans"))
    new = next_ids(rows.filter("reject_reason IS NULL"), tables, "delivery_challans")
    outcome = decided(
        rows.drop("dc_id").join(new.select("req_seq", "dc_id"), "req_seq", "left"), "so_id", "dc_id")
    return Result(Edits(
        tables, delivery_challans=Edit(inserted=lambda: new_rows("delivery_challans", new))), outcome)


def dispatch_dc(tables: Tables, requests: DataFrame, as_of: str, span: int = SPAN) -> Result:
    """Dispatch challans: shipped rises, reserved falls, the order status follows.

    ``requests``: ``req_seq``, ``dc_id``. A challan is refused as a whole if a line
    would ship more than its order line or take an item's reserved stock below zero.
    Both limits are resources of one queue, so the result is that of the challans
    run one after the other. Dispatching again changes nothing.
    """
    challans, order_lines = tables["delivery_challans"], tables["sales_order_lines"]
    stock = tables["stock_balance"]
    asked = durable(looked_up(
        first_requests(requests, "dc_id"), challans.select("dc_id", "so_id", "status"), "dc_id"))
    todo = asked.filter("status <> 'Dispatched'").select("doc", "dc_id", "so_id")
    many = todo.count() > FEW
    ordered = order_lines.select(
        "so_id", "item_id",
        (F.col("ordered_quantity") - F.col("shipped_quantity")).alias("order_free"))
    held = stock.select("item_id", F.col("reserved_quantity").alias("stock_free"))
    lines = durable(
        tables["delivery_challan_lines"].join(todo, "dc_id")
        .select("doc", "dc_id", "so_id", "item_id", "dc_line_id",
                F.col("shipped_quantity").alias("need"))
        .join(rows_for(ordered, todo, ["so_id"], many), ["so_id", "item_id"], "left")
        .join(held, "item_id", "left"))
    item = F.col("item_id")
    limits = lines.select("doc", "need", F.explode(F.array(
        F.struct(F.lit("order").alias("kind"), F.col("so_id").alias("owner"), item,
                 F.col("order_free").cast("decimal(13,2)").alias("free"),
                 (F.col("dc_line_id") * 2).alias("line_no")),
        F.struct(F.lit("stock").alias("kind"), F.lit(0).cast("bigint").alias("owner"), item,
                 F.col("stock_free").cast("decimal(13,2)").alias("free"),
                 (F.col("dc_line_id") * 2 + 1).alias("line_no")))).alias("l"))
    queue = allocate(todo, limits.select("doc", "need", "l.*"), ["kind", "owner", "item_id"], span)

    done = todo.join(queue.verdicts.filter("accepted"), "doc").select("doc", "dc_id", "so_id")
    taken = lines.join(done.select("doc"), "doc", "left_semi")

    def moved(how: str) -> DataFrame:
        return move_stock(stock, taken.select(
            "item_id", F.lit(0).cast(QTY).alias("available"),
            (-F.col("need")).alias("reserved")), as_of, how)

    def raised(how: str, lines: DataFrame = order_lines) -> DataFrame:
        sums = taken.groupBy("so_id", "item_id").agg(F.sum("need").alias("_out"))
        return with_generated(
            lines.join(sums, ["so_id", "item_id"], how).withColumn(
                "shipped_quantity",
                (F.col("shipped_quantity") + F.coalesce("_out", F.lit(0))).cast(QTY)),
            "sales_order_lines")

    def orders(how: str) -> DataFrame:
        touched = done.select("so_id").distinct()
        lines_after = raised("left", rows_for(order_lines, done, ["so_id"], many))
        state = touched.join(_complete(lines_after, touched), "so_id", "left").select(
            "so_id", F.coalesce("_complete", F.lit(False)).alias("_complete"))
        return _set_status(
            tables["sales_orders"], state,
            F.when(F.col("_complete"), "Shipped").otherwise("Processing"), as_of, how)

    def sent(how: str) -> DataFrame:
        marked = challans.join(done.select("dc_id", F.lit(True).alias("_done")), "dc_id", how)
        return marked.withColumns({
            "status": F.when(F.col("_done"), "Dispatched").otherwise(F.col("status")),
            "dispatched_at": stamped(F.col("_done"), "dispatched_at", as_of),
        }).select(*MODEL["delivery_challans"].names)

    def outcome() -> DataFrame:
        unmatched = lines.groupBy("doc").agg(
            F.bool_or(F.col("order_free").isNull()).alias("unmatched"))
        again = asked.filter("status = 'Delivered'").select("doc", F.lit(True).alias("was_delivered"))
        reasons = queue.failed(turns_of(requests, asked, "dc_id")).select(
            F.col("turn").alias("req_seq"),
            F.when(F.col("kind") == "order", message(OVER_SHIPMENT, item))
            .otherwise(message(RESERVED_BELOW_ZERO, item)).alias("reason"))
        state_of = asked.join(queue.verdicts, "doc", "left").join(
            unmatched, "doc", "left").join(again, "doc", "left")
        return requests.select("req_seq", "dc_id").join(
            state_of.select("dc_id", "doc", "accepted", "unmatched", "was_delivered"),
            "dc_id", "left"
        ).join(reasons, "req_seq", "left").select(
            "req_seq", "dc_id",
            F.when(F.col("accepted") & (F.col("req_seq") == F.col("doc")), ACCEPTED)
            .when(~F.col("accepted"), REJECTED).otherwise(UNCHANGED).alias("outcome"),
            "reason", F.coalesce("unmatched", F.lit(False)).alias("unmatched"),
            F.coalesce("was_delivered", F.lit(False)).alias("was_delivered"))

    return Result(Edits(
        tables, delivery_challans=Edit(sent), stock_balance=Edit(moved),
        sales_order_lines=Edit(raised), sales_orders=Edit(orders)), outcome)


def _complete(lines: DataFrame, touched: DataFrame) -> DataFrame:
    """Whether nothing is pending on the touched orders; no row for orders without lines."""
    return (
        lines.select("so_id", "pending_quantity").join(touched, "so_id", "left_semi")
        .groupBy("so_id").agg(F.bool_and(F.col("pending_quantity") == 0).alias("_complete")))


def _set_status(orders: DataFrame, state: DataFrame, status, as_of: str, how: str) -> DataFrame:
    """Give the orders in ``state`` the new status where it is not NULL, and stamp them."""
    new = state.withColumn("_new", status).filter("_new IS NOT NULL").select("so_id", "_new")
    marked = orders.join(new, "so_id", how)
    return marked.withColumns({
        "updated_at": stamped(F.col("_new").isNotNull(), "updated_at", as_of),
        "status": F.coalesce("_new", "status"),
    }).select(*MODEL["sales_orders"].names)


def deliver_dc(tables: Tables, requests: DataFrame, as_of: str) -> Result:
    """Deliver challans; an order with nothing pending becomes delivered too.

    ``requests``: ``req_seq``, ``dc_id``. Any status but Delivered will do: a challan
    that was never dispatched is delivered without stock effect, and flagged.
    """
    challans = tables["delivery_challans"]
    first = durable(looked_up(
        first_requests(requests, "dc_id"), challans.select("dc_id", "so_id", "status"), "dc_id"))
    done = first.filter("status <> 'Delivered'")

    def orders(how: str) -> DataFrame:
        state = _complete(tables["sales_order_lines"], done.select("so_id").distinct())
        return _set_status(
            tables["sales_orders"], state, F.when(F.col("_complete"), "Delivered"), as_of, how)

    def sent(how: str) -> DataFrame:
        marked = challans.join(done.select("dc_id", F.lit(True).alias("_done")), "dc_id", how)
        return marked.withColumns({
            "status": F.when(F.col("_done"), "Delivered").otherwise(F.col("status")),
            "delivered_at": stamped(F.col("_done"), "delivered_at", as_of),
        }).select(*MODEL["delivery_challans"].names)

    outcome = requests.select("req_seq", "dc_id").join(
        first.select("dc_id", "doc", "status"), "dc_id", "left").select(
        "req_seq", "dc_id",
        F.when((F.col("status") != "Delivered") & (F.col("req_seq") == F.col("doc")), ACCEPTED)
        .otherwise(UNCHANGED).alias("outcome"),
        F.coalesce(~F.col("status").isin("Dispatched", "Delivered"), F.lit(False))
        .alias("not_dispatched"))
    return Result(Edits(tables, delivery_challans=Edit(sent), sales_orders=Edit(orders)), outcome)


def advance_so(tables: Tables, requests: DataFrame, as_of: str) -> Result:
    """Move orders one step by hand, Pending to Processing to Packed.

    ``requests``: ``req_seq``, ``so_id``; each request is one step. No more than two
    steps can pass, so only the first two requests of an order need their rank. The
    rank filter is applied on the map side before the shuffle. The orders need no rank, only how many steps come.
    """
    orders = tables["sales_orders"]
    once = choose(F.col("status"), NEXT_STATUS)
    twice = choose(once, NEXT_STATUS)
    # the status a request finds, after the steps before it
    found = (
        F.when(F.col("step") == 1, F.col("status"))
        .when(F.col("step") == 2, F.coalesce(once, F.col("status")))
        .otherwise(F.coalesce(twice, once, F.col("status"))))

    def outcome() -> DataFrame:
        order = Window.partitionBy("so_id").orderBy("req_seq")
        early = requests.select("so_id", "req_seq").withColumn(
            "step", F.row_number().over(order)).filter("step <= 2")
        rows = (
            requests.select("req_seq", "so_id")
            .join(durable(early).select("req_seq", "step"), "req_seq", "left")
            .join(rows_for(orders.select("so_id", "status"), requests, ["so_id"]), "so_id", "left")
            .withColumn("step", F.coalesce("step", F.lit(3))))
        rows = rows.withColumn("found", found).withColumn("new_status", choose(F.col("found"), NEXT_STATUS))
        rows = rows.withColumn(
            "reject_reason",
            F.when(F.col("status").isNull(), message(SO_UNKNOWN, F.col("so_id")))
            .when(F.col("new_status").isNull(),
                  message(SO_NOT_ADVANCED, F.col("so_id"), F.col("found"))))
        return decided(rows, "so_id", "new_status")

    def advanced(how: str) -> DataFrame:
        steps = requests.groupBy("so_id").agg(F.least(F.count("*"), F.lit(2)).alias("steps"))
        moved = orders.join(steps, "so_id", how).withColumn(
            "_new", F.when(F.col("steps") == 2, F.coalesce(twice, once))
            .when(F.col("steps") == 1, once))
        if how == "inner":
            moved = moved.filter("_new IS NOT NULL")
        return moved.withColumns({
            "updated_at": stamped(F.col("_new").isNotNull(), "updated_at", as_of),
            "status": F.coalesce("_new", "status"),
        }).select(*MODEL["sales_orders"].names)

    return Result(Edits(tables, sales_orders=Edit(advanced)), outcome)


def cancel_so(tables: Tables, requests: DataFrame, as_of: str, span: int = SPAN) -> Result:
    """Cancel open orders and give what is not shipped back to available stock.

    ``requests``: ``req_seq``, ``so_id``. A release that would take reserved stock
    below zero refuses the whole cancellation.
    """
    orders, stock = tables["sales_orders"], tables["stock_balance"]
    first = durable(looked_up(
        first_requests(requests, "so_id"), orders.select("so_id", "status"), "so_id"))
    todo = first.filter(~F.col("status").isin(*CLOSED_STATUS)).select("doc", "so_id")
    held = stock.select("item_id", F.col("reserved_quantity").alias("free"))
    lines = durable(
        tables["sales_order_lines"].filter("ordered_quantity - shipped_quantity > 0")
        .join(todo, "so_id")
        .select("doc", "so_id", "item_id", F.col("so_line_id").alias("line_no"),
                (F.col("ordered_quantity") - F.col("shipped_quantity")).cast(QTY).alias("need"))
        .join(held, "item_id", "left"))
    queue = allocate(todo, lines, ["item_id"], span)
    done = todo.join(queue.verdicts.filter("accepted"), "doc").select("doc", "so_id")
    released = lines.join(done.select("doc"), "doc", "left_semi")

    def moved(how: str) -> DataFrame:
        return move_stock(stock, released.select(
            "item_id", F.col("need").alias("available"), (-F.col("need")).alias("reserved")), as_of, how)

    def cancelled(how: str) -> DataFrame:
        return _set_status(orders, done.select("so_id"), F.lit("Cancelled"), as_of, how)

    def outcome() -> DataFrame:
        reasons = queue.failed(turns_of(requests, first, "so_id")).select(
            F.col("turn").alias("req_seq"), message(RESERVED_BELOW_ZERO, F.col("item_id")).alias("reason"))
        state_of = first.join(queue.verdicts, "doc", "left")
        rows = requests.select("req_seq", "so_id").join(
            state_of.select("so_id", "doc", "status", "accepted"), "so_id", "left").join(
            reasons, "req_seq", "left")
        now = F.when(F.col("accepted") & (F.col("req_seq") != F.col("doc")), "Cancelled").otherwise(
            F.col("status"))
        rows = rows.withColumn(
            "reject_reason",
            F.when(F.col("status").isNull(), message(SO_UNKNOWN, F.col("so_id")))
            .when(now.isin(*CLOSED_STATUS), message(SO_NOT_CANCELLED, F.col("so_id"), now))
            .otherwise(F.col("reason")))
        return decided(rows, "so_id")

    return Result(Edits(tables, sales_orders=Edit(cancelled), stock_balance=Edit(moved)), outcome)
