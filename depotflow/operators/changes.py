"""Change sets: the rows that a job inserts, updates and deletes, each with a flag.

A change set has the columns of its table and ``change``. A job describes its edit of a table once, as
joins of the table with what is to happen to it; the kind of the join makes either the whole
table or the rows that change out of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"
FLAG = "change"


@dataclass(frozen=True)
class Edit:
    """What happens to a table.

    ``updated("left")`` is the table with its rows changed, ``updated("inner")`` the changed rows
    only. ``inserted()`` has the new rows. ``left("left_anti")`` is the table without the deleted rows,
    ``left("left_semi")`` the deleted ones. A table has updates or deletions, not both.
    """

    updated: Callable[[str], DataFrame] | None = None
    inserted: Callable[[], DataFrame] | None = None
    left: Callable[[str], DataFrame] | None = None

    def whole(self, old: Callable[[], DataFrame]) -> DataFrame:
        """The table after the edit."""
        rows = self.updated("left") if self.updated else self.left("left_anti") if self.left else old()
        return rows.unionByName(self.inserted()) if self.inserted else rows

    def rows(self) -> DataFrame:
        """The change set."""
        parts = [made.withColumn(FLAG, F.lit(flag)) for made, flag in (
            (self.updated and self.updated("inner"), UPDATE), (self.inserted and self.inserted(), INSERT),
            (self.left and self.left("left_semi"), DELETE)) if made is not None]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


class Edits(Mapping):
    """The tables a job changes, as they are afterwards; plans are built when they are asked for."""

    def __init__(self, tables: Mapping[str, DataFrame], **edits: Edit) -> None:
        self._tables, self._edits = tables, edits
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._edits[name].whole(lambda: self._tables[name])
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._edits)

    def __len__(self) -> int:
        return len(self._edits)

    def rows(self, name: str) -> DataFrame:
        """The change set of a table."""
        return self._edits[name].rows()

    def sets(self) -> dict[str, DataFrame]:
        """The change sets of all tables."""
        return {name: self.rows(name) for name in self._edits}


def applied(old: DataFrame, changes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The table after a change set, which has each key once."""
    kept = old.join(changes.select(*key), list(key), "left_anti")
    return kept.unionByName(changes.filter(F.col(FLAG) != DELETE).select(*old.columns))


def newest(changes: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """Of several changes of a key the one of the highest ``order``."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])
