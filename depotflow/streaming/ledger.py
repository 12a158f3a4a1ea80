"""The stock ledger as a stream: movements in, balances and alerts out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from depotflow.functions.columns import choose, is_low
from depotflow.schemas import QTY

RECEIPT, RESERVE, DISPATCH, RELEASE = "receipt", "reserve", "dispatch", "release"

# event type -> movement; other events move nothing
MOVEMENT_OF_EVENT = {
    "signup": RECEIPT,
    "purchase": RESERVE,
    "view": DISPATCH,
    "click": RELEASE,
}


def movements(events: DataFrame) -> DataFrame:
    """Stock movements of the event log: item, id, kind and quantity in cents."""
    return events.select(
        F.col("user_id").alias("item_id"),
        "event_id",
        choose(F.col("event_type"), MOVEMENT_OF_EVENT).alias("kind"),
        (F.col("value").cast(QTY) * 100).cast("bigint").alias("cents"),
    ).filter("kind IS NOT NULL AND cents > 0")


class _Ledger(StatefulProcessor):
    """Carries (available, reserved) per item; a movement below zero is refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._balance = handle.getValueState("balance", "available bigint, reserved bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        available, reserved = self._balance.get() if self._balance.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values("event_id", ignore_index=True)
        accepted, left, held = [], [], []
        for kind, cents in zip(batch["kind"], batch["cents"].tolist()):
            passes = True
            if kind == RECEIPT:
                available += cents
            elif kind == RESERVE:
                passes = available >= cents
                if passes:
                    available, reserved = available - cents, reserved + cents
            else:
                passes = reserved >= cents
                if passes:
                    reserved -= cents
                    available += cents if kind == RELEASE else 0
            accepted.append(passes)
            left.append(available)
            held.append(reserved)
        self._balance.update((available, reserved))
        yield pd.DataFrame({
            "item_id": batch["item_id"], "event_id": batch["event_id"], "kind": batch["kind"],
            "cents": batch["cents"], "accepted": accepted, "available_cents": left,
            "reserved_cents": held})

    def close(self) -> None:
        pass


def _quantity(cents: str) -> Column:
    return (F.col(cents) * F.expr("0.01BD")).cast(QTY)


def stock_ledger(moves: DataFrame) -> DataFrame:
    """One row per movement with the balance after it, in the order of ``event_id``.

    State is two numbers per item and does not expire, as stock rows do not. The
    rows of an item within a micro-batch are sorted in one task, so the source must
    bound the batch (see ``feed``, or a rate limit of the source) and keep the order.
    """
    walked = moves.groupBy("item_id").transformWithStateInPandas(
        statefulProcessor=_Ledger(),
        outputStructType="item_id bigint, event_id bigint, kind string, cents bigint, "
                         "accepted boolean, available_cents bigint, reserved_cents bigint",
        outputMode="Append", timeMode="None")
    return walked.select(
        "item_id", "event_id", "kind", _quantity("cents").alias("quantity"), "accepted",
        _quantity("available_cents").alias("available_quantity"),
        _quantity("reserved_cents").alias("reserved_quantity"))


def low_stock(ledger: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Movements that leave an active item at or below its reorder level."""
    items = tables["items"].filter("is_active").select("item_id", "item_name", "reorder_level")
    return ledger.filter("accepted").join(items, "item_id").filter(
        is_low(F.col("available_quantity"), F.col("reorder_level"))).select(
        "item_id", "event_id", "item_name", "available_quantity", "reorder_level",
        (F.col("reorder_level") - F.col("available_quantity")).cast(QTY)
        .alias("shortage_quantity"))


def init_stock(events: DataFrame) -> DataFrame:
    """A zero balance at the first sight of an item, nothing later on."""
    zero = F.lit(0).cast(QTY)
    return events.select(F.col("user_id").alias("item_id")).dropDuplicates(["item_id"]).select(
        "item_id", zero.alias("available_quantity"), zero.alias("reserved_quantity"))
