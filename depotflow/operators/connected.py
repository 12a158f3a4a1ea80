"""Connected components of pairs, by forests that tasks make and that shrink from round to round.

A round deals the pairs evenly over tasks, whatever their ends are, so a busy node is spread. Each task
joins its pairs with a disjoint-set forest and gives the root of every node it saw. A node that several
tasks saw links its roots to the one of least priority; these links are the pairs of the next
round. Roots are chosen by a priority that is new in each round, so that a part of the nodes is
never a root and drops out, also in long chains. Pairs that fit into one task need one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.stored import durable

PAIRS = 1 << 18  # pairs that a task joins


def _roots(a: np.ndarray, b: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """The root of each of ``len(priority)`` nodes: the one of least priority that it reaches."""
    place = np.argsort(priority, kind="stable")
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    root, a, b = np.arange(len(place)), rank[a], rank[b]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return place[root[rank]]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def components(pairs: DataFrame, most: int = PAIRS, turn: int = 0) -> DataFrame:
    """``node`` and ``root`` of every node of ``pairs`` (bigint columns ``a`` and ``b``).

    Nodes that are joined by pairs share a root, one of them. ``pairs`` is read twice and should be stored.
    """
    tasks = max(1, -(-pairs.count() // most))

    def work(batches):
        tables = [pa.Table.from_batches([batch]) for batch in batches]
        if tables:
            table = pa.concat_tables(tables)
            ends = np.stack([table[c].to_numpy() for c in ("a", "b")])
            nodes, codes = np.unique(ends, return_inverse=True)
            codes = codes.reshape(ends.shape)
            mixed = (nodes.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            found = nodes[_roots(codes[0], codes[1], mixed ^ (mixed >> np.uint64(29)))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found)], names=["node", "root"])

    dealt = pairs.repartition(1) if tasks == 1 else pairs.repartition(tasks, F.xxhash64("a", "b"))
    local = durable(dealt.select("a", "b").mapInArrow(work, "node long, root long"))
    if tasks == 1:
        return local
    own = local.groupBy("node").agg(F.min("root").alias("first"))
    further = durable(local.join(own, "node").where(F.col("root") != F.col("first"))
                      .select(F.col("root").alias("a"), F.col("first").alias("b")).distinct())
    ends = components(further, most, turn + 1)
    return (own.join(ends.select(F.col("node").alias("first"), F.col("root").alias("last")), "first", "left")
            .select("node", F.coalesce("last", "first").alias("root")))
