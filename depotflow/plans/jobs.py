"""What the document jobs share.

A job takes the tables and a batch of requests and returns the tables it changes
and one outcome per request. Requests carry ``req_seq``, a unique bigint that is
their arrival order; the result equals running them one after the other, each in
its own transaction. A request that a rule refuses changes nothing and comes back
as a row with its reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotflow.functions.columns import stamp, with_generated
from depotflow.operators.changes import Edits
from depotflow.operators.quality import orphan_flags, row_reason, rows_for
from depotflow.operators.running import ranked
from depotflow.schemas import MODEL, QTY
from depotflow.stored import durable

Tables = Mapping[str, DataFrame]

ACCEPTED, REJECTED, UNCHANGED = "accepted", "rejected", "unchanged"


class Changes(Mapping):
    """Changed tables by name; the plan of each is built when it is asked for."""

    def __init__(self, **builders: Callable[[], DataFrame]) -> None:
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


class Result:
    """Changed tables by name, and the outcome of each request.

    ``changed`` has whole tables; ``changed.sets()`` has the rows that change, with a flag.
    """

    def __init__(self, changed: Edits,
                 outcome: DataFrame | Callable[[], DataFrame]) -> None:
        self.changed = changed
        self._outcome = outcome

    @cached_property
    def outcome(self) -> DataFrame:
        return self._outcome() if callable(self._outcome) else self._outcome

    def applied_to(self, tables: Tables) -> Tables:
        """All tables after the job."""
        return After(tables, self.changed)


class After(Mapping):
    """Tables with some of them replaced, the others still made on demand."""

    def __init__(self, tables: Tables, changed: Mapping[str, DataFrame]) -> None:
        self._tables, self._changed = tables, changed

    def __getitem__(self, name: str) -> DataFrame:
        return self._changed[name] if name in self._changed else self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter({*self._tables, *self._changed})

    def __len__(self) -> int:
        return len({*self._tables, *self._changed})


def text_null() -> Column:
    return F.lit(None).cast("string")


def first_requests(requests: DataFrame, key: str) -> DataFrame:
    """The first request of each key, as ``doc``; summed up on the map side first."""
    return requests.groupBy(key).agg(F.min("req_seq").alias("doc"))


def looked_up(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requests with the row of ``table`` they name, or NULLs where there is none."""
    return requests.join(rows_for(table, requests, [key]), key, "left")


def next_ids(rows: DataFrame, tables: Tables, table: str) -> DataFrame:
    """Give new rows the ids after the highest one, in arrival order."""
    key = MODEL[table].key[0]
    if key in rows.columns:
        return rows
    highest = tables[table].agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    return ranked(rows, "req_seq", "_nr").withColumn(key, (highest + F.col("_nr")).cast("bigint")
                                                     ).drop("_nr")


def known_ids(tables: Tables, rows: DataFrame, table: str) -> DataFrame:
    """Refuse given ids that are missing or in the table."""
    key = MODEL[table].key[0]
    used = rows_for(tables[table].select(key, F.lit(True).alias("_used")), rows, [key])
    reason = (F.when(F.col(key).isNull(), F.lit(f"not_null {key}"))
              .when(F.col("_used"), F.lit(f"primary_key {key}")))
    return rows.join(used, key, "left").withColumn(
        "reject_reason", F.coalesce("reject_reason", reason)).drop("_used")


def taken_ids(tables: Tables, rows: DataFrame, table: str) -> DataFrame:
    """Refuse given ids that are missing, in the table, or those of an earlier accepted request."""
    key = MODEL[table].key[0]
    rows = durable(known_ids(tables, rows, table))
    firsts = rows.filter("reject_reason IS NULL").groupBy(key).agg(F.min("req_seq").alias("_first"))
    return rows.join(firsts, key, "left").withColumn("reject_reason", F.coalesce(
        "reject_reason", F.when(F.col("req_seq") > F.col("_first"), F.lit(f"primary_key {key}")))).drop("_first")


def turns_of(requests: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """When each document asks: ``doc``, its first request, and ``turn``, this one and each later one."""
    return requests.select(key, F.col("req_seq").alias("turn")).join(first.select(key, "doc"), key).select("doc", "turn")


def new_rows(table: str, rows: DataFrame) -> DataFrame:
    """Rows as the table has them; generated columns are computed."""
    if any(c.generated for c in MODEL[table].columns):
        rows = with_generated(rows, table)
    return rows.select(*MODEL[table].names)


def checked(tables: Tables, rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with ``reject_reason``: broken row rules first, then missing parents."""
    rows = durable(rows.withColumn("_rule", row_reason(rows, table)))
    rows = orphan_flags(tables, rows, table)
    reason = F.coalesce("_rule", F.when(
        F.col("orphan").isNotNull(), F.concat(F.lit("foreign_key "), F.col("orphan"))))
    return rows.withColumn("reject_reason", reason).drop("_rule", "orphan")


def is_free_pair(rows: DataFrame, tables: Tables, table: str, pair: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``pair_used``: true where the table already has the key pair."""
    used = rows_for(tables[table].select(*pair, F.lit(True).alias("pair_used")), rows, list(pair))
    return rows.join(used, list(pair), "left").withColumn(
        "pair_used", F.coalesce("pair_used", F.lit(False)))


def move_stock(stock: DataFrame, moves: DataFrame, as_of: str, how: str = "left") -> DataFrame:
    """Add ``available`` and ``reserved`` sums to the balances and stamp touched rows.

    ``moves`` has ``item_id``, ``available`` and ``reserved``; moves of one item are
    added up before they meet the balance, so a busy item is one row in the join. ``how`` is the kind
    of that join: "inner" gives the touched rows only.
    """
    sums = moves.groupBy("item_id").agg(
        F.sum("available").alias("_a"), F.sum("reserved").alias("_r"))
    moved = stock.join(sums, "item_id", how)
    touched = F.col("_a").isNotNull()
    return moved.select(
        "item_id",
        F.when(touched, F.col("available_quantity") + F.col("_a"))
        .otherwise(F.col("available_quantity")).cast(QTY).alias("available_quantity"),
        F.when(touched, F.col("reserved_quantity") + F.col("_r"))
        .otherwise(F.col("reserved_quantity")).cast(QTY).alias("reserved_quantity"),
        stamped(touched, "last_updated", as_of))


def stamped(touched: Column, column: str, as_of: str) -> Column:
    """The batch time on every touched row, even where no value changed."""
    return F.when(touched, stamp(as_of)).otherwise(F.col(column)).alias(column)


def stamp_changes(df: DataFrame, keys: DataFrame, key: str, column: str, as_of: str) -> DataFrame:
    """Stamp the rows of the touched keys."""
    marked = keys.select(key).distinct().withColumn("_touched", F.lit(True))
    return df.join(marked, key, "left").select(*[
        stamped(F.col("_touched").isNotNull(), c, as_of) if c == column else F.col(c)
        for c in df.columns])


def decided(rows: DataFrame, *extra: str) -> DataFrame:
    """Outcome rows from ``reject_reason``."""
    return rows.select(
        "req_seq", *extra,
        F.when(F.col("reject_reason").isNull(), ACCEPTED).otherwise(REJECTED).alias("outcome"),
        F.col("reject_reason").alias("reason"))
