"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

1. Each text becomes its set of word shingles, a digest of the set, and a MinHash signature.
   Texts with equal sets are one class from here on, however many there are.
2. The forest: every tree sorts the classes by its own order of the signature's numbers. The
   tables are sorted by range, so that a dense region is spread over tasks. Classes next to
   each other, with at least ``Forest.shallow`` numbers in common, are candidates: where few classes share
   a prefix, all of them are compared; where many do, only the next ones, which agree to a
   greater depth. So the depth adapts to the region.
3. Candidates whose sizes and signatures allow the similarity are confirmed on the full sets, and
   links are joined to components by rounds of hooking to the least neighbour.
4. The first ``FIRST`` trees, in which each class meets the next one only, join most of a large group
   by a few links a class. Then all trees are looked at, across the components known by then: a
   pair within a component adds nothing, so a large group does not come up again in every tree.
5. Regions that were too dense to compare all of their classes, and that still hold more than one
   component, are compared in blocks, across components only: first signatures, which tells the classes that
   have a candidate at all, then the full sets of these. A pair is looked at in the first
   tree whose region it shares. A block gives no more links than join its classes, so rows grow with
   the classes, not with the pairs, and no class is left out for standing in a crowd.

Links are found with a probability that grows with the number of trees. Both it and the depth of a
prefix follow from the threshold: a pair at the threshold shares a prefix in at least one of the trees
but for a chance of ``MISS``, a pair above it with a smaller one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotflow.llm.text import MIX, NOT_SPACE, gather, mix, shingles, slices, words
from depotflow.session import durable

SHINGLE = 3
THRESHOLD = 85  # per cent: shared shingles of all shingles of the two
NUMBERS = 192  # numbers of a signature, 16 bits each
MISS = 2e-8  # chance at most that a pair at the threshold shares a region in no tree
FIRST = 4  # trees that join most of large groups before all trees are looked at
DEEP = 14  # numbers by which a tree sorts
NEXT = 2  # classes that a class is compared with in the order of a tree, on either side
CHUNK = 2048  # classes of a block where a dense region is compared in blocks
SETS = 8 << 20  # bytes of full sets of such a block
DEVIATIONS = 6  # standard deviations by which a pair's agreeing numbers may fall short of the threshold
BITS = 25  # places of the table that tells tasks which classes are asked for

_step = np.arange(1, NUMBERS + 1, dtype=np.uint64)
FACTORS = mix(_step * MIX) | np.uint64(1)
SHIFTS = mix(_step + (_step << np.uint64(32)))


@dataclass(frozen=True)
class Forest:
    """What a threshold asks of the trees."""

    trees: int
    shallow: int  # numbers that a region of a tree has in common at least
    agree: int  # agreeing numbers of two signatures at least

    @property
    def orders(self) -> np.ndarray:
        """The first numbers of all trees are different ones; each goes on with numbers of others."""
        return np.array([[(self.shallow * t + k) % NUMBERS if k < self.shallow
                          else (self.shallow * t + 4 + 37 * (k + 1) + 11 * t) % NUMBERS for k in range(DEEP)]
                         for t in range(self.trees)])


def planned(threshold: int) -> Forest:
    """The deepest regions for which the numbers suffice for as many trees as ``MISS`` asks for."""
    like = threshold / 100
    agree = math.floor(NUMBERS * like - DEVIATIONS * math.sqrt(NUMBERS * like * (1 - like)))
    for shallow in range(DEEP, 0, -1):
        shared = like ** shallow
        trees = math.ceil(math.log(MISS) / math.log(1 - shared)) if shared < 1 else 1
        if trees * shallow <= NUMBERS:
            return Forest(trees, shallow, agree)
    raise ValueError(f"a threshold of {threshold} per cent asks for more than {NUMBERS} numbers")


def signature(values: np.ndarray) -> np.ndarray:
    """For each of the hash functions the least of the values, by its highest 16 bits."""
    best = np.full(NUMBERS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(values), 256):
        some = values[first:first + 256, None] * FACTORS + SHIFTS
        best = np.minimum(best, some.min(axis=0))
    return (mix(best) >> np.uint64(48)).astype(np.uint16)


def _sets(column, size: int):
    """The set of shingles of each text, ascending; fewer words than that are one shingle."""
    split = words(column, NOT_SPACE)
    hashes = split.hashes()
    marks = shingles(hashes, size)
    for a, b in zip(split.rows[:-1].tolist(), split.rows[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.uint64)
        elif b - a < size:
            yield shingles(hashes[a:b], b - a)
        else:
            own = np.sort(marks[a:b - size + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            yield own[keep]


def _node(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Of each row of (doc_id, text): size of its set, the set's digest (null if empty), signature,
    and a mark of the text, by which the text is found again. A column ``digest`` is kept."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    more = [c for c in docs.columns if c == "digest"]

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts, nodes, numbers = [], [], []
                for values in _sets(part["text"], size):
                    counts.append(len(values)), nodes.append(_node(values))
                    numbers.append(signature(values).astype(">u2").tobytes() if len(values) else None)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array(numbers, pa.binary()), part["mark"], *[part[c] for c in more]],
                    names=["doc_id", "n_shingles", "node", "numbers", "mark", *more])

    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(
        work, ", ".join([f"doc_id {doc_id}, n_shingles long, node binary, numbers binary, mark long",
                         *(f"{c} string" for c in more)]))


def forest(classes: DataFrame, plan: Forest, first: int | None = None) -> DataFrame:
    """A row per tree (of the first trees only, if told) and class: the class's numbers in the tree's
    order, and its component so far."""
    kind = pa.binary(2 * DEEP)
    orders = plan.orders[:first]

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            table = np.frombuffer(b"".join(batch["numbers"].to_pylist()), np.uint8).reshape(n, NUMBERS, 2)
            for tree, order in enumerate(orders):
                keys = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(table[:, order].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, tree, np.int32)), keys.cast(pa.binary()), batch["node"],
                     batch["root"], batch["n"]],
                    names=["tree", "key", "node", "root", "n"])

    return classes.select("node", "root", "n", "numbers").mapInArrow(
        work, "tree int, key binary, node binary, root binary, n long")


def neighbours(trees: DataFrame, plan: Forest, threshold: int, steps: int) -> DataFrame:
    """Pairs of classes of different components, up to ``steps`` places from each other in the order
    of a tree, across tasks too."""
    in_order = trees.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    prefix = 2 * plan.shallow

    def work(batches):
        held = None
        first_rows: list = []
        n_edges = 0

        def pairs(rows, new_from):
            """Pairs of rows where the second is at ``new_from`` or later."""
            tree = rows["tree"].to_numpy()
            keys = np.frombuffer(b"".join(rows["key"].to_pylist()), np.uint8).reshape(len(tree), -1)
            region = keys[:, :prefix]
            n = rows["n"].to_numpy()
            left, right = [], []
            for step in range(1, steps + 1):
                second = np.arange(max(new_from, step), len(tree))
                one = second - step
                near = ((tree[one] == tree[second]) & (region[one] == region[second]).all(axis=1)
                        & (100 * np.minimum(n[one], n[second]) >= threshold * np.maximum(n[one], n[second])))
                left.append(one[near]), right.append(second[near])
            one, second = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
            apart = pc.not_equal(rows["root"].take(one), rows["root"].take(second))
            one, second = one.filter(apart), second.filter(apart)
            none = pa.nulls(len(one))
            return pa.RecordBatch.from_arrays(
                [rows["node"].take(one), rows["node"].take(second), none.cast(pa.int32()),
                 none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.binary())],
                names=["a", "b", "tree", "key", "n", "root"])

        def edges(rows):
            return pa.RecordBatch.from_arrays(
                [rows["node"], pa.nulls(rows.num_rows, pa.binary()), rows["tree"], rows["key"], rows["n"],
                 rows["root"]], names=["a", "b", "tree", "key", "n", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if n_edges < steps:
                first_rows.append(batch.slice(0, steps - n_edges))
                n_edges += first_rows[-1].num_rows
            old = held.num_rows if held is not None else 0
            rows = pa.Table.from_batches([held, batch] if old else [batch]).combine_chunks().to_batches()[0]
            yield pairs(rows, old)
            held = rows.slice(max(0, rows.num_rows - steps))
        for rows in first_rows + ([held] if held is not None else []):
            yield edges(rows)

    found = durable(in_order.mapInArrow(work, "a binary, b binary, tree int, key binary, n long, "
                                             "root binary"))
    # The first and last rows of each task stand next to those of other tasks: a few rows a task.
    region = Window.partitionBy("tree", F.substring("key", 1, prefix)).orderBy("key", "a")
    edges = found.where(F.col("b").isNull()).select("tree", "key", "a", "n", "root").distinct()
    across = [edges.select("a", F.lead("a", step).over(region).alias("b"), "n",
                           F.lead("n", step).over(region).alias("m"), "root",
                           F.lead("root", step).over(region).alias("other")) for step in range(1, steps + 1)]
    over = across[0]
    for more in across[1:]:
        over = over.unionByName(more)
    over = over.where(F.col("b").isNotNull() & (F.col("root") != F.col("other"))
                      & (100 * F.least("n", "m") >= threshold * F.greatest("n", "m")))
    return (found.where(F.col("b").isNotNull()).select("a", "b").unionByName(over.select("a", "b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def agreeing(pairs: DataFrame, classes: DataFrame, plan: Forest) -> DataFrame:
    """Pairs whose signatures agree in enough numbers, with that number."""
    numbers = classes.select("node", "numbers")
    both = (pairs.join(numbers.select(F.col("node").alias("a"), F.col("numbers").alias("x")), "a")
            .join(numbers.select(F.col("node").alias("b"), F.col("numbers").alias("y")), "b"))

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, NUMBERS) for c in "xy")
            same = (x == y).sum(axis=1)
            keep = pa.array(np.flatnonzero(same >= plan.agree))
            yield pa.RecordBatch.from_arrays(
                [batch["a"].take(keep), batch["b"].take(keep), pa.array(same.astype(np.int32)).take(keep)],
                names=["a", "b", "same"])

    return both.select("a", "b", "x", "y").mapInArrow(work, "a binary, b binary, same int")


def full_sets(asked: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The sets of shingles (``node``, ``items``) of classes (``node``, ``mark``), made anew of one text of each
    class; a bit table of fixed size tells tasks which texts those may be. ``asked`` should be stored."""
    places = (asked.select(F.shiftrightunsigned("mark", 64 - BITS).alias("place")).distinct()
              .groupBy(F.shiftright("place", 6).alias("word"))
              .agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits")).toPandas())
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[places["word"].to_numpy(np.int64)] = places["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches):
        table, told = shared.value, set()
        for batch in batches:
            place = (batch["mark"].to_numpy().view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
            for part in slices(batch.filter(pa.array(table[place >> 6] >> (place & 63) & 1 == 1)), "text"):
                nodes, sets = [], []
                for values in _sets(part["text"], size):
                    node = _node(values)
                    if node is not None and node not in told:
                        told.add(node)
                        nodes.append(node), sets.append(values.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())],
                                                 names=["node", "items"])

    sets = (docs.select("text", F.xxhash64("text").alias("mark")).mapInArrow(work, "node binary, items binary")
            .join(asked, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")))
    return durable(sets)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int,
              threshold: int) -> DataFrame:
    """Pairs that reach the threshold on the full sets of shingles."""
    pairs = durable(pairs.select("a", "b"))
    asked = durable(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
                    .join(classes.select("node", "mark"), "node"))
    sets = full_sets(asked, docs, size)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"))

    def test(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])

    return durable(both.select("a", "b", "x", "y").mapInArrow(test, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every linked node: the least node that it reaches.

    Each round hooks every node to its least neighbour, follows these hooks to their ends, and
    contracts the links; a round at least halves the nodes that still have links.
    """
    spark = links.sparkSession
    roots, links = None, durable(links.where("a <> b").distinct())
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = durable(both.groupBy("a").agg(F.min("b").alias("b"))
                        .select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:
            further = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = durable(hooks.join(further, "root").select("node", "root", "next"))
            moved = jumped.where("root <> next").limit(1).count()
            hooks = jumped.select("node", F.col("next").alias("root"))
            if not moved:
                break
        if roots is None:
            roots = hooks
        else:
            roots = durable(roots.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("next")),
                                       "root", "left")
                            .select("node", F.coalesce("next", "root").alias("root")))
        ends = hooks.select(F.col("node"), "root")
        links = durable(links.join(ends.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
                        .join(ends.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
                        .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                        .distinct())
    return roots if roots is not None else spark.createDataFrame([], "node binary, root binary")


def crowds(classes: DataFrame, plan: Forest) -> DataFrame:
    """Regions of trees that were too dense to compare in full and hold several components."""
    region = F.substring("key", 1, 2 * plan.shallow).alias("region")
    return (forest(classes, plan).groupBy("tree", region)
            .agg(F.count("*").alias("size"), F.min("root").alias("x"), F.max("root").alias("y"))
            .where((F.col("size") > NEXT + 1) & (F.col("x") != F.col("y"))).select("tree", "region", "size"))


class Crowd:
    """Classes of a dense region of a tree: which pairs of them are candidates."""

    def __init__(self, rows: pa.Table, plan: Forest, threshold: int):
        self.numbers = np.frombuffer(b"".join(rows["numbers"].to_pylist()), np.uint16).reshape(-1, NUMBERS)
        self.n = rows["n"].to_numpy()
        self.own = rows["own"].to_numpy()
        self.root = np.unique([r.hex() for r in rows["root"].to_pylist()], return_inverse=True)[1]
        self.plan, self.threshold = plan, threshold
        self.blocks = rows["i"][0].as_py(), rows["j"][0].as_py()
        # The regions that the classes are in in earlier trees.
        kind = np.dtype((np.void, 2 * plan.shallow))
        self.earlier = np.array([
            np.unique(np.ascontiguousarray(self.numbers[:, order[:plan.shallow]]).view(kind).ravel(),
                      return_inverse=True)[1]
            for order in plan.orders[:rows["tree"][0].as_py()]]).reshape(-1, len(self.n))

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each class of one block with its candidates in the other: of other components, of a size and
        a signature that allow the similarity, and in no region together before."""
        i, j = self.blocks
        right = np.flatnonzero(self.own == j)
        for x in np.flatnonzero(self.own == i).tolist():
            near = right[right > x] if i == j else right
            near = near[(self.root[near] != self.root[x])
                        & (100 * np.minimum(self.n[near], self.n[x]) >= self.threshold * np.maximum(self.n[near], self.n[x]))]
            near = near[(self.numbers[near] == self.numbers[x]).sum(axis=1) >= self.plan.agree]
            near = near[~(self.earlier[:, near] == self.earlier[:, x, None]).any(axis=0)]
            if len(near):
                yield x, near


def _in_blocks(rows: DataFrame, chunks: Column) -> DataFrame:
    """Rows of regions in each pair of blocks of theirs: ``i`` and ``j``, and ``own``, the row's block."""
    return (rows.withColumn("chunks", chunks)
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .drop("chunks", "other"))


def crowded(regions: DataFrame, classes: DataFrame, plan: Forest, threshold: int) -> DataFrame:
    """The classes of such regions that have a candidate there: ``tree``, ``region``, ``node``."""
    rows = forest(classes, plan).withColumn("region", F.substring("key", 1, 2 * plan.shallow)).drop("key")
    placed = _in_blocks(rows.join(regions, ["tree", "region"]).join(classes.select("node", "numbers"), "node"),
                        F.ceil(F.col("size") / CHUNK).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        found = np.zeros(rows.num_rows, bool)
        for x, near in Crowd(rows, plan, threshold).pairs():
            found[x] = found[near] = True
        return rows.select(["tree", "region", "node"]).filter(pa.array(found))

    return (placed.groupBy("tree", "region", "i", "j")
            .applyInArrow(compare, "tree int, region binary, node binary").distinct())


def joined(needed: DataFrame, classes: DataFrame, sets: DataFrame, plan: Forest, threshold: int) -> DataFrame:
    """Links (a, b) that join the classes of each region whose full sets reach the threshold."""
    rows = needed.join(classes.select("node", "root", "n", "numbers"), "node")
    sizes = rows.groupBy("tree", "region").agg(F.ceil(F.sum(8 * F.col("n")) / SETS).cast("int").alias("parts"))
    placed = _in_blocks(rows.join(sizes, ["tree", "region"]).join(sets, "node"), F.greatest("parts", F.lit(1)))

    def compare(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        crowd = Crowd(rows, plan, threshold)
        bounds = np.concatenate(([0], np.cumsum(crowd.n)))
        _, items = np.unique(np.frombuffer(b"".join(rows["items"].to_pylist()), np.uint64), return_inverse=True)
        mark = np.zeros(int(items.max(initial=-1)) + 1, bool)
        root, a, b = crowd.root.copy(), [], []
        for x, near in crowd.pairs():
            mark[items[bounds[x]:bounds[x + 1]]] = True
            while len(near := near[root[near] != root[x]]):
                some, near = near[:64], near[64:]
                lengths = crowd.n[some]
                shared = mark[items[gather(bounds[some], lengths)]].astype(np.int64)
                both = np.add.reduceat(shared, np.cumsum(lengths) - lengths)
                for y in some[100 * both >= threshold * (crowd.n[x] + lengths - both)].tolist():
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                        a.append(x), b.append(y)
            mark[items[bounds[x]:bounds[x + 1]]] = False
        one, other = (rows["node"].take(pa.array(ends, pa.int64())) for ends in (a, b))
        return pa.table({"a": one, "b": other})

    return (placed.groupBy("tree", "region", "i", "j").applyInArrow(compare, "a binary, b binary")
            .distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD,
                    id_column: str = "doc_id", text_column: str = "text", keys: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``node`` (digest of its set), ``n_shingles``,
    ``component_id`` (the least id reachable over links) and ``kept`` (whether that is its own).

    Texts that are null or without words have an empty set and are linked with nothing. Rows
    with equal sets are linked, rows of equal id too. A row without an id is linked by its
    text; its component is that of rows with ids, or null, and it is never kept. Further
    columns are left out. ``keys`` adds ``root``, the key of the component (null for an empty set), and
    ``digest`` of the text, by which rows of one id are told apart.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    more = ["digest"] if keys else []
    plan = planned(threshold)
    sketched = durable(sketches(docs.withColumn("digest", F.sha2("text", 256)) if keys else docs, size))
    classes = durable(sketched.where(F.col("node").isNotNull()).groupBy("node")
                      .agg(F.first("n_shingles").alias("n"), F.first("numbers").alias("numbers"),
                           F.min("mark").alias("mark")))

    def linked(candidates: DataFrame) -> DataFrame:
        return confirmed(candidates, classes, docs, size, threshold)

    def further(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The components when more links are known."""
        if links.isEmpty():
            return roots
        return durable(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                                  .unionByName(links)))

    def with_roots(roots: DataFrame) -> DataFrame:
        return durable(classes.join(roots, "node", "left")
                       .withColumn("root", F.coalesce("root", "node")))

    # Trees are made anew for the range boundaries and for the sort: they are larger than what they are made of.
    alone = forest(classes.withColumn("root", F.col("node")), plan, FIRST)
    roots = durable(components(linked(agreeing(neighbours(alone, plan, threshold, 1), classes, plan))))
    trees = forest(with_roots(roots), plan)
    roots = further(roots, linked(agreeing(neighbours(trees, plan, threshold, NEXT), classes, plan)))
    own = with_roots(roots)
    regions = durable(crowds(own, plan))
    if not regions.isEmpty():
        needed = durable(crowded(regions, own, plan, threshold))
        asked = durable(needed.select("node").distinct().join(classes.select("node", "mark"), "node"))
        roots = further(roots, durable(joined(needed, own, full_sets(asked, docs, size), plan, threshold)))
    rows = (sketched.select("doc_id", "n_shingles", "node", *more)
            .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    return (rows.join(least, "root", "left")
            .withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
            .select("doc_id", "node", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
                    *(["root", *more] if keys else [])))
