"""First come, first served, all or nothing.

Documents ask for quantities of several resources. In the order of ``doc``, each
one is accepted if every line fits into what the accepted earlier ones left, and
takes nothing otherwise. The result equals running the documents one after the
other, but no task holds the whole queue of a resource:

1. A line larger than the whole capacity refuses its document for good. Such
   documents take nothing and leave the queue at once.
2. A resource whose remaining total need fits into its capacity can refuse nobody.
   Only lines on the other, contended resources are looked at further.
3. For the rest, two running totals bound what earlier documents take: all that
   are not yet refused (``most``) and those surely accepted (``least``). A
   document that fits under ``most`` is accepted, one that does not fit over
   ``least`` is refused. Such a round is repeated while it settles at least half of the
   open documents, so the number of rounds is at most the logarithm of theirs.
4. What is open then waits for each other in chains. Open documents that share a contended
   resource form components, which are independent; each is folded in order, as a stream that
   holds what is left of the component's resources and one document's lines, nothing else.
   Documents that are settled already take part by their lines only and join nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.operators.connected import components
from depotflow.operators.running import SPAN, running_totals
from depotflow.stored import durable


@dataclass(frozen=True)
class Allocation:
    """The decisions; ``verdicts`` has ``doc`` and ``accepted``."""

    verdicts: DataFrame
    _limited: DataFrame
    _refused: DataFrame
    _resource: list[str]
    _span: int

    def failed(self, turns: DataFrame | None = None, left: bool = False) -> DataFrame:
        """For each refused ``doc`` and ``turn`` the resource of its first line that does not fit then.

        ``turns`` (``doc``, ``turn``) tells when documents ask, the first time and again; without it, each
        asks once, at its own place. A document that was refused stays so, as what is free only
        falls, but another line may be the first to fail. A line above the whole capacity is sure, and one
        that fits with all that was ever accepted never failed. Only for lines in
        between the totals at the turn are needed, or for all if ``left``, what was free at the turn,
        is to be told with the ``need`` of the line.
        """
        resource = self._resource
        flagged = self._limited.join(self._refused, "doc", "left")
        given = flagged.filter("refused IS NULL")
        taken = given.groupBy(*resource).agg(F.sum("need").alias("taken"), F.count("*").alias("_given"))
        asking = flagged.filter("refused")
        asking = (asking.withColumn("turn", F.col("doc")) if turns is None
                  else asking.join(turns.select("doc", "turn"), "doc"))
        stored = durable(
            asking.join(taken, resource, "left")
            .filter("need > free OR need + taken > free")
            .select("doc", "turn", "line_no", *resource, "need", "free", "_given"))
        suspects = stored.drop("_given")
        failing = suspects.filter("need > free").withColumn("left", F.col("free"))
        unsure = suspects.filter("need <= free")
        if left:
            failing, unsure = failing.filter("false"), suspects
        if not unsure.isEmpty():
            none = F.lit(None)
            busiest = stored.groupBy(*resource).agg(
                (F.count("*") + F.coalesce(F.max("_given"), F.lit(0))).alias("_n")).agg(F.max("_n")).head()[0]
            met = running_totals(
                given.join(unsure.select(*resource).distinct(), resource, "left_semi")
                .select(*resource, F.col("doc").alias("turn"), "need", none.cast("bigint").alias("doc"),
                        none.cast("bigint").alias("line_no"), "free")
                .unionByName(unsure),
                resource, "turn", {"before": F.when(F.col("doc").isNull(), F.col("need"))}, self._span, busiest)
            failing = failing.unionByName(
                met.filter("doc IS NOT NULL AND before + need > free")
                .select(*suspects.columns, (F.col("free") - F.col("before")).alias("left")))
        told = [*resource, "need", "left"] if left else resource
        first = failing.groupBy("doc", "turn").agg(F.min_by(F.struct(*told), "line_no").alias("r"))
        return first.select("doc", "turn", "r.*")


def in_turn(rows: Iterator[tuple]) -> Iterator[tuple[int, bool]]:
    """Decide open documents of rows (component, doc, resource, need, free, settled) that come in the order
    of component and doc. A settled document takes without being asked."""
    left: dict = {}
    at, wanted = None, []

    def judged() -> bool:
        fits = all(left[r] >= need for r, need, _ in wanted)
        if fits or wanted[0][2]:
            for r, need, _ in wanted:
                left[r] -= need
        return fits

    for component, doc, resource, need, free, settled in rows:
        if (component, doc) != at:
            if wanted:
                fits = judged()
                if not wanted[0][2]:
                    yield at[1], fits
            if at and component != at[0]:
                left.clear()
            at, wanted = (component, doc), []
        left.setdefault(resource, free)
        wanted.append((resource, need, settled))
    if wanted:
        fits = judged()
        if not wanted[0][2]:
            yield at[1], fits


def folded(waiting: DataFrame, resource: list[str]) -> DataFrame:
    """``doc`` and ``verdict`` of the open documents in ``waiting``, component by component."""
    open_rows = waiting.filter("state IS NULL")
    heads = open_rows.groupBy(*resource).agg(F.min("doc").alias("b"))
    # Every open document is joined with the first one of each of its resources.
    pairs = durable(open_rows.select("doc", *resource).join(heads, resource)
                    .select(F.col("doc").alias("a"), "b").distinct())
    of_head = components(pairs).select(F.col("node").alias("b"), F.col("root").alias("component"))
    rows = (waiting.join(heads.join(of_head, "b").select(*resource, "component"), resource)
            .select("component", "doc", F.to_json(F.struct(*resource)).alias("resource"),
                    *[(F.col(c) * 100).cast("bigint").alias(c) for c in ("need", "free")],
                    F.col("state").isNotNull().alias("settled"))
            .repartition("component").sortWithinPartitions("component", "doc"))

    def work(batches):
        def each():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in range(6)), strict=True)

        decided = in_turn(each())
        while some := [d for d, _ in zip(decided, range(1 << 16))]:
            yield pa.RecordBatch.from_pydict({"doc": [d for d, _ in some], "verdict": [v for _, v in some]})

    return rows.mapInArrow(work, "doc long, verdict boolean")


def allocate(docs: DataFrame, lines: DataFrame, resource: list[str],
             span: int = SPAN) -> Allocation:
    """Decide documents.

    ``docs``: ``doc`` (unique bigint, the arrival order). ``lines``: ``doc``, the
    resource columns, ``need``, ``free`` (capacity, the same on all lines of a
    resource; NULL means no limit) and ``line_no`` (order in the document). A document
    has at most one line per resource. ``lines`` is read several times and should be stored.
    """
    limited = lines.filter("free IS NOT NULL")
    hopeless = durable(limited.filter("need > free").select("doc").distinct())
    hopeful = limited.join(hopeless, "doc", "left_anti")
    contended = (
        hopeful.groupBy(*resource)
        .agg(F.sum("need").alias("asked"), F.min("free").alias("limit"), F.count("*").alias("_n"))
        .filter("asked > limit").select(*resource, "_n"))
    counted = durable(hopeful.select("doc", *resource, "need", "free").join(contended, resource))
    busiest = counted.agg(F.max("_n")).head()[0]
    queue = counted.drop("_n")

    waiting = queue.withColumn("state", F.lit(None).cast("boolean"))
    settled = [hopeless.withColumn("verdict", F.lit(False))]
    still = queue.select("doc").distinct().count()
    while still:
        flows = running_totals(waiting, resource, "doc", {
            "most": F.col("need"),
            "least": F.when(F.col("state"), F.col("need")),
        }, span, busiest)
        need, free = F.col("need"), F.col("free")
        verdict = (
            flows.filter("state IS NULL").groupBy("doc").agg(
                F.bool_and(F.col("most") + need <= free).alias("fits"),
                F.bool_or(F.col("least") + need > free).alias("fails"))
            .select("doc", F.expr("CASE WHEN fits THEN true WHEN fails THEN false END")
                    .alias("verdict"), F.lit(True).alias("was_open")))
        marked = durable(waiting.join(verdict, "doc", "left").select(
            "doc", *resource, "need", "free", F.coalesce("state", "verdict").alias("state"),
            "was_open"))
        settled.append(
            marked.filter("was_open AND state IS NOT NULL").groupBy("doc").agg(
                F.bool_and("state").alias("verdict")))
        undecided = marked.filter("state IS NULL")
        before, still = still, undecided.select("doc").distinct().count()
        # refused lines take nothing; the queue of a settled resource is done with
        waiting = marked.drop("was_open").filter("state IS NULL OR state").join(
            undecided.select(*resource).distinct(), resource, "left_semi")
        if still and 2 * still > before:
            settled.append(durable(folded(waiting, resource)))
            break

    verdicts = reduce(DataFrame.unionByName, settled)
    refused = verdicts.filter("NOT verdict").select("doc", F.lit(True).alias("refused"))

    accepted = docs.select("doc").join(verdicts, "doc", "left").select(
        "doc", F.coalesce("verdict", F.lit(True)).alias("accepted"))
    return Allocation(accepted, limited, refused, resource, span)
