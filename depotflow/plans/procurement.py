"""Headers, order lines and the buying side: create, add lines, receive, cancel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotflow.functions.columns import stamp, with_defaults, with_generated
from depotflow.functions.messages import (
    DUPLICATE, OVER_RECEIPT, PO_NOT_CANCELLED, PO_UNKNOWN, message)
from depotflow.operators.allocate import allocate
from depotflow.operators.changes import Edit, Edits
from depotflow.operators.quality import FEW, rows_for
from depotflow.operators.running import SPAN
from depotflow.plans.jobs import (
    ACCEPTED, REJECTED, UNCHANGED, Result, Tables, checked, decided, first_requests,
    is_free_pair, known_ids, looked_up, move_stock, new_rows, next_ids, stamped, taken_ids, turns_of)
from depotflow.schemas import MODEL, QTY
from depotflow.stored import durable


def create_documents(tables: Tables, table: str, requests: DataFrame, as_of: str) -> Result:
    """New purchase orders, receipts or sales orders.

    ``requests`` has ``req_seq`` and the fields of the header; absent fields take
    their default. Ids are given by the caller or follow the highest one; of requests with
    an id that is taken, by the table or by an earlier request, none is accepted.
    """
    fields = [f for f in MODEL[table].names if f != MODEL[table].key[0]]
    rows = checked(tables, with_defaults(requests, table, as_of, fields), table)
    rows = durable(rows)
    key = MODEL[table].key[0]
    if key in rows.columns:
        rows = durable(taken_ids(tables, rows, table))
    new = next_ids(rows.filter("reject_reason IS NULL"), tables, table)
    outcome = decided(rows.drop(key).join(new.select("req_seq", key), "req_seq", "left"), key)
    return Result(Edits(tables, **{table: Edit(inserted=lambda: new_rows(table, new))}), outcome)


# line table -> (header key, name of the quantity, name of the price)
LINE_FIELDS = {
    "purchase_order_lines": ("po_id", "ordered_quantity", "unit_cost"),
    "goods_receipt_lines": ("grn_id", "received_quantity", None),
    "delivery_challan_lines": ("dc_id", "shipped_quantity", None),
    "sales_order_lines": ("so_id", "ordered_quantity", "unit_price"),
}


def line_rows(requests: DataFrame, table: str) -> DataFrame:
    """Requests as rows of a line table: quantities rounded to two decimals."""
    _, quantity, price = LINE_FIELDS[table]
    rows = requests.withColumnRenamed("quantity", quantity)
    rows = rows.withColumn(quantity, F.col(quantity).try_cast(QTY))
    if price:
        value = F.col(price).try_cast(QTY) if price in rows.columns else F.lit(0).cast(QTY)
        rows = rows.withColumn(price, value)
    done = {"purchase_order_lines": "received_quantity", "sales_order_lines": "shipped_quantity"}
    if table in done:
        rows = rows.withColumn(done[table], F.lit(0).cast(QTY))
    return rows


def given_ids(tables: Tables, rows: DataFrame, table: str, pair: tuple[str, ...], duplicate: Column) -> DataFrame:
    """Refuse lines whose given id or whose pair is taken at their turn.

    An id and a pair are resources that serve one request each; a request needs both.
    """
    key = MODEL[table].key[0]
    rows = durable(known_ids(tables, rows, table))
    sound = rows.filter("reject_reason IS NULL")
    one = F.lit(1).cast(QTY)
    needs = durable(sound.select(F.col("req_seq").alias("doc"), one.alias("need"), one.alias("free"), F.explode(F.array(
        F.struct(F.lit("id").alias("kind"), F.col(key).alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).alias("line_no")),
        F.struct(F.lit("pair").alias("kind"), *[F.col(c).cast("bigint").alias(n) for c, n in zip(pair, "xy", strict=True)],
                 F.lit(1).alias("line_no")))).alias("of")).select("doc", "need", "free", "of.*"))
    queue = allocate(sound.select(F.col("req_seq").alias("doc")), needs, ["kind", "x", "y"])
    late = queue.failed().select(F.col("doc").alias("req_seq"), F.col("kind").alias("_late"))
    return rows.join(late, "req_seq", "left").withColumn("reject_reason", F.coalesce(
        "reject_reason", F.when(F.col("_late") == "id", F.lit(f"primary_key {key}")).when(
            F.col("_late") == "pair", duplicate))).drop("_late")


def first_of_pair(rows: DataFrame, tables: Tables, table: str, pair: tuple[str, ...], duplicate: Column) -> DataFrame:
    """Refuse lines whose pair is in the table or is that of an earlier sound request.

    What is known of a pair is gathered first, keys only, so the rows are dealt once. A row comes once for
    each row of the table that has its pair.
    """
    asked = rows.groupBy(*pair).agg(F.min(F.when(F.col("reject_reason").isNull(), F.col("req_seq"))).alias("_first"))
    held = rows_for(tables[table].select(*pair), rows, list(pair), rows.count() > FEW)
    pairs = asked.join(held.groupBy(*pair).agg(F.count("*").alias("_held")), list(pair), "left")
    late = F.col("_held").isNotNull() | (F.col("req_seq") != F.col("_first"))
    copies = F.sequence(F.lit(1), F.coalesce(F.col("_held").cast("int"), F.lit(1)))
    return (rows.join(pairs, list(pair), "left")
            .withColumn("reject_reason", F.coalesce("reject_reason", F.when(late, duplicate)))
            .withColumn("_copy", F.explode(copies)).drop("_copy", "_first", "_held"))


def add_lines(tables: Tables, table: str, requests: DataFrame) -> Result:
    """New lines of purchase orders, receipts or challans.

    A (header, item) pair is taken by the first sound request. The status of the
    header does not matter. Ids are given by the caller or follow the highest one;
    a request whose id is taken, by the table or by an earlier accepted request, is refused.
    """
    header, quantity, _ = LINE_FIELDS[table]
    pair = (header, "item_id")
    rows = checked(tables, line_rows(requests, table), table)
    duplicate = message(DUPLICATE, F.lit(f"{header}, item_id"))
    if MODEL[table].key[0] in rows.columns:
        rows = durable(is_free_pair(rows, tables, table, pair))
        rows = rows.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("pair_used"), duplicate)))
        rows = durable(given_ids(tables, rows, table, pair, duplicate))
    else:
        rows = first_of_pair(rows, tables, table, pair, duplicate)
    taken = rows.filter("reject_reason IS NULL")

    def lines() -> DataFrame:
        """The accepted lines, stored as numbering reads them several times."""
        kept = [c for c in MODEL[table].names if c in taken.columns]
        return new_rows(table, next_ids(durable(taken.select("req_seq", *kept)), tables, table))

    return Result(Edits(tables, **{table: Edit(inserted=lines)}), decided(rows, header, "item_id"))


def confirm_grn(tables: Tables, requests: DataFrame, as_of: str, span: int = SPAN) -> Result:
    """Confirm draft receipts: stock and order lines rise, the order status follows.

    ``requests``: ``req_seq``, ``grn_id``. A receipt is refused as a whole if a line
    would exceed its order line. Confirming again changes nothing. A line whose item
    is not on the order is not limited and still raises stock; ``unmatched`` tells.
    """
    receipts = tables["goods_receipts"]
    order_lines = tables["purchase_order_lines"]
    asked = durable(looked_up(
        first_requests(requests, "grn_id"), receipts.select("grn_id", "po_id", "status"), "grn_id"))
    todo = asked.filter("status <> 'Confirmed'").select("doc", "grn_id", "po_id")
    many = todo.count() > FEW
    ordered = order_lines.select(
        "po_id", "item_id",
        (F.col("ordered_quantity") - F.col("received_quantity")).alias("free"))
    lines = durable(
        tables["goods_receipt_lines"].join(todo, "grn_id")
        .select("doc", "grn_id", "po_id", "item_id", F.col("grn_line_id").alias("line_no"),
                F.col("received_quantity").alias("need"))
        .join(rows_for(ordered, todo, ["po_id"], many), ["po_id", "item_id"], "left"))
    queue = allocate(todo, lines, ["po_id", "item_id"], span)

    done = todo.join(queue.verdicts.filter("accepted"), "doc").select("doc", "grn_id", "po_id")
    taken = lines.join(done.select("doc"), "doc", "left_semi")

    def stock(how: str) -> DataFrame:
        return move_stock(
            tables["stock_balance"],
            taken.select("item_id", F.col("need").alias("available"),
                         F.lit(0).cast(QTY).alias("reserved")),
            as_of, how)

    def raised(how: str, lines: DataFrame = order_lines) -> DataFrame:
        sums = taken.groupBy("po_id", "item_id").agg(F.sum("need").alias("_in"))
        return with_generated(
            lines.join(sums, ["po_id", "item_id"], how).withColumn(
                "received_quantity",
                (F.col("received_quantity") + F.coalesce("_in", F.lit(0))).cast(QTY)),
            "purchase_order_lines")

    def orders(how: str) -> DataFrame:
        touched = done.select("po_id").distinct()
        complete = raised("left", rows_for(order_lines, done, ["po_id"], many)).groupBy("po_id").agg(
            F.bool_and(F.col("pending_quantity") == 0).alias("_complete"))
        # an order without lines has no verdict on completeness and counts as open
        state = touched.join(complete, "po_id", "left").select(
            "po_id", F.coalesce("_complete", F.lit(False)).alias("_complete"))
        hit = F.col("_complete").isNotNull()
        return tables["purchase_orders"].join(state, "po_id", how).select(
            "po_id", "supplier_id", "created_by",
            F.when(F.col("_complete"), "Completed").when(hit, "Partially_Received")
            .otherwise(F.col("status")).alias("status"),
            "notes", "created_at", stamped(hit, "updated_at", as_of),
            F.when(F.col("_complete"), stamp(as_of)).otherwise(F.col("received_at"))
            .alias("received_at"))

    def confirmed(how: str) -> DataFrame:
        return receipts.join(
            done.select("grn_id", F.lit(True).alias("_done")), "grn_id", how).withColumn(
            "status", F.when(F.col("_done"), "Confirmed").otherwise(F.col("status"))).select(
            *MODEL["goods_receipts"].names)

    def outcome() -> DataFrame:
        unmatched = lines.groupBy("doc").agg(F.bool_or(F.col("free").isNull()).alias("unmatched"))
        reasons = queue.failed(turns_of(requests, asked, "grn_id")).select(
            F.col("turn").alias("req_seq"), message(OVER_RECEIPT, F.col("item_id")).alias("reason"))
        state_of = asked.join(queue.verdicts, "doc", "left").join(unmatched, "doc", "left")
        return requests.select("req_seq", "grn_id").join(
            state_of.select("grn_id", "doc", "accepted", "unmatched"), "grn_id", "left"
        ).join(reasons, "req_seq", "left").select(
            "req_seq", "grn_id",
            F.when(F.col("accepted") & (F.col("req_seq") == F.col("doc")), ACCEPTED)
            .when(~F.col("accepted"), REJECTED).otherwise(UNCHANGED).alias("outcome"),
            "reason", F.coalesce("unmatched", F.lit(False)).alias("unmatched"))

    return Result(Edits(
        tables, goods_receipts=Edit(confirmed), stock_balance=Edit(stock),
        purchase_order_lines=Edit(raised), purchase_orders=Edit(orders)), outcome)


def cancel_po(tables: Tables, requests: DataFrame, as_of: str) -> Result:
    """Cancel pending purchase orders; stock is not touched."""
    orders = tables["purchase_orders"]
    first = durable(looked_up(
        first_requests(requests, "po_id"), orders.select("po_id", "status"), "po_id"))
    rows = requests.select("req_seq", "po_id").join(first, "po_id", "left")
    # a second request finds the order already cancelled by the first
    now = F.when((F.col("status") == "Pending") & (F.col("req_seq") != F.col("doc")),
                 "Cancelled").otherwise(F.col("status"))
    rows = rows.withColumn("status", now).withColumn(
        "reject_reason",
        F.when(F.col("status").isNull(), message(PO_UNKNOWN, F.col("po_id")))
        .when(F.col("status") != "Pending",
              message(PO_NOT_CANCELLED, F.col("po_id"), F.col("status"))))

    def cancelled(how: str) -> DataFrame:
        pending = first.filter("status = 'Pending'").select("po_id", F.lit(True).alias("_asked"))
        marked = orders.join(pending, "po_id", how)
        hit = F.col("_asked").isNotNull()
        return marked.withColumns({
            "updated_at": stamped(hit, "updated_at", as_of),
            "status": F.when(hit, "Cancelled").otherwise(F.col("status")),
        }).select(*MODEL["purchase_orders"].names)

    return Result(Edits(tables, purchase_orders=Edit(cancelled)), decided(rows, "po_id"))
