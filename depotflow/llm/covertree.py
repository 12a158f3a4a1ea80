"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are dealt to cells around pivots and cells to blocks of bounded size; each block becomes a
cover tree in its own task. A node covers its points within a radius of its centre, and its
children are spread by farthest-first choice until they cover the node within a smaller radius.
Queries are grouped and indexed in the same way. A search walks pairs of nodes: for a query
node (centre q, radius s) and a data node (centre c, radius r) no inner product exceeds
q.c + |q| r + |c| s + r s, so a pair below the worst k-th score of the group's queries is left
out. It runs in two rounds: each query group against the blocks of its own cell, which gives
every query a first k-th score, then against every other block whose covering
radius does not rule it out.

Equal vectors are kept as one point with the ids that can matter: the smallest k + 1. Bounds
only skip pairs that cannot reach a result, so the result is exact. Ties go to smaller ids.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotflow.session import durable

BASE = 1.3  # children cover a node within its radius divided by this
FANOUT = 24  # children of a node; the radii stay right with any number of them
LEAF = 128  # points of a leaf
BLOCK_ROWS = 4096  # rows of a data block, about
GROUP_ROWS = 512  # rows of a query group, about
MOST_PIVOTS = 1024  # cells, so the pivots that reach every task are bounded
SCALE = 64


class CoverTree:
    """Points in tree order; node i covers points begin[i]:end[i] within radius[i] of centre[i]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points = points
        self.centre, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        self._grow(0, len(points), 0, leaf)
        self.points = points[self.order]
        self.centre = np.array(self.centre)
        self.norm = np.sqrt((self.centre ** 2).sum(axis=1))
        self.radius = np.array(self.radius)

    def _grow(self, begin: int, end: int, centre: int, leaf: int) -> int:
        """Add the node of points order[begin:end] around the point at order[centre]."""
        node = len(self.centre)
        own = self.order[begin:end]
        middle = self.points[self.order[centre]]
        far = np.sqrt(((self.points[own] - middle) ** 2).sum(axis=1))
        radius = float(far.max())
        self.centre.append(middle), self.radius.append(radius)
        self.begin.append(begin), self.end.append(end), self.children.append([])
        if end - begin <= leaf or radius == 0:
            return node
        nearest, chosen = np.zeros(len(own), np.int64), [centre - begin]
        while far.max() > radius / BASE and len(chosen) < FANOUT:
            chosen.append(int(far.argmax()))
            to_new = np.sqrt(((self.points[own] - self.points[own[chosen[-1]]]) ** 2).sum(axis=1))
            closer = to_new < far
            nearest[closer], far = len(chosen) - 1, np.minimum(far, to_new)
        by_child = np.argsort(nearest, kind="stable")
        self.order[begin:end] = own[by_child]
        place = np.empty(len(own), np.int64)
        place[by_child] = np.arange(len(own))
        at = begin
        for child, n in enumerate(np.bincount(nearest, minlength=len(chosen)).tolist()):
            if n:
                self.children[node].append(
                    self._grow(at, at + n, begin + int(place[chosen[child]]), leaf))
                at += n
        return node


class Index:
    """A cover tree over distinct vectors, with the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int | None):
        order = np.argsort(ids, kind="stable")
        distinct, which = np.unique(vectors[order], axis=0, return_inverse=True)
        which = which.ravel()
        by_point = np.argsort(which, kind="stable")
        ids, which = ids[order][by_point], which[by_point]
        first = np.searchsorted(which, which)  # place among the ids of the same vector
        if keep is not None:
            few = np.arange(len(ids)) - first < keep
            ids, which = ids[few], which[few]
        self.tree = CoverTree(distinct)
        place = np.empty(len(distinct), np.int64)
        place[self.tree.order] = np.arange(len(distinct))
        by_place = np.argsort(place[which], kind="stable")
        self.ids = ids[by_place]
        self.first = np.searchsorted(place[which][by_place], np.arange(len(distinct) + 1))


    def pack(self) -> bytes:
        """The arrays of the index, whole numbers in the least type that holds them."""
        tree = self.tree
        most = int(np.abs(tree.points).max()) if tree.points.size else 0
        kind = np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int32
        return pickle.dumps((tree.points.astype(kind), tree.centre.astype(kind), tree.radius, tree.begin,
                             tree.end, tree.children, self.ids, self.first))

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        index, tree = cls.__new__(cls), CoverTree.__new__(CoverTree)
        points, centre, tree.radius, tree.begin, tree.end, tree.children, index.ids, index.first = \
            pickle.loads(data)
        tree.points, tree.centre = points.astype(float), centre.astype(float)
        tree.norm = np.sqrt((tree.centre ** 2).sum(axis=1))
        index.tree = tree
        return index


class Best:
    """The k best of each query so far: scores and ids, best first."""

    def __init__(self, ids: np.ndarray, k: int, worst: np.ndarray):
        self.ids, self.k = ids, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.bound = worst.copy()  # what a score must reach

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.ids[rows][:, None], -np.inf, scores)
        some = (scores >= self.bound[rows][:, None]).any(axis=1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        all_scores = np.concatenate((self.scores[rows], scores), axis=1)
        all_ids = np.concatenate((self.found[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.found[rows] = np.take_along_axis(all_ids, order, axis=1)
        self.bound[rows] = np.maximum(self.bound[rows], self.scores[rows, -1])


def search(queries: Index, data: Index, k: int, worst: np.ndarray) -> Best:
    """Walk pairs of nodes; ``worst`` is a score that each query (by ``queries.ids``) reaches k times."""
    best = Best(queries.ids, k, worst)
    a, b = queries.tree, data.tree
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        rows = np.arange(queries.first[a.begin[i]], queries.first[a.end[i]])
        limit = a.centre[i] @ b.centre[j] + a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] \
            + a.radius[i] * b.radius[j]
        # Rounding is far below half a unit, and scores are whole numbers.
        if limit + 0.5 < best.bound[rows].min():
            continue
        mine, theirs = a.children[i], b.children[j]
        if theirs and (not mine or b.radius[j] >= a.radius[i]):
            close = b.centre[theirs] @ a.centre[i] + a.norm[i] * b.radius[theirs]
            stack += [(i, theirs[t]) for t in np.argsort(close)]  # the most promising last, so first
        elif mine:
            stack += [(c, j) for c in mine]
        else:
            points = a.points[a.begin[i]:a.end[i]]
            scores = points @ b.points[b.begin[j]:b.end[j]].T
            of_query = np.repeat(np.arange(len(points)), np.diff(queries.first[a.begin[i]:a.end[i] + 1]))
            of_data = np.repeat(np.arange(b.end[j] - b.begin[j]),
                                np.diff(data.first[b.begin[j]:b.end[j] + 1]))
            ids = data.ids[data.first[b.begin[j]]:data.first[b.end[j]]]
            best.add(rows, ids, scores[of_query][:, of_data])
    return best


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``vector`` (floor(64 x) of each component); rows without a finite vector are out."""
    vector = F.col(vector_column).cast("array<double>")
    usable = F.col("x").isNotNull() & ~F.exists("x", lambda x: x.isNull() | F.isnan(x)
                                                | (F.abs(x) == F.lit(float("inf"))))
    return (rows.select(F.col(id_column).cast("long").alias("id"), vector.alias("x"))
            .where(F.col("id").isNotNull() & usable)
            .select("id", F.transform("x", lambda x: F.floor(x * SCALE).cast("double")).alias("vector")))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as filled up with zeros."""
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if width and (lengths == width).all():
        return values.reshape(len(column), width).copy()
    at = 0
    for i, n in enumerate(lengths.tolist()):
        out[i, :n] = values[at:at + n]
        at += n
    return out


def dealt(vectors: DataFrame, pivots: np.ndarray, width: int, rows_of_block: int) -> DataFrame:
    """Add ``cell`` (the nearest pivot), ``far`` (the distance to it) and ``block``: cells are cut by
    a hash of the id as their size asks, so a cell with a third of all vectors is many blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        pivots = shared.value
        for batch in batches:
            points = _matrix(batch["vector"], width)
            square = (pivots ** 2).sum(axis=1) - 2 * points @ pivots.T
            cell = square.argmin(axis=1)
            far = np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["vector"], pa.array(cell.astype(np.int32)), pa.array(far)],
                names=["id", "vector", "cell", "far"])

    celled = durable(vectors.mapInArrow(nearest, "id long, vector array<double>, cell int, far double"))
    blocks = F.ceil(F.count("*") / rows_of_block).cast("int").alias("blocks")
    sizes = celled.groupBy("cell").agg(blocks)  # a row per pivot, so it may be broadcast
    return (celled.join(F.broadcast(sizes), "cell")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"))


def built(rows: DataFrame, width: int, keep: int | None) -> DataFrame:
    """A row per block: its index, its centre and radius, and the number of its ids."""

    def build(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["vector"].combine_chunks(), width)
        index = Index(table["id"].to_numpy(), vectors, keep)
        return pa.table({"cell": table["cell"][:1], "block": table["block"][:1],
                         "centre": pa.array([index.tree.centre[0].tolist()], pa.list_(pa.float64())),
                         "radius": pa.array([float(index.tree.radius[0])]),
                         "ids": pa.array([len(index.ids)], pa.int64()),
                         "index": pa.array([index.pack()], pa.binary())})

    return durable(rows.groupBy("cell", "block").applyInArrow(
        build, "cell int, block int, centre array<double>, radius double, ids long, index binary"))


FOUND = "own_cell int, group int, query_id long, vec_id long, score long"


def walked(pairs: DataFrame, k: int) -> DataFrame:
    """Search each pair of a query group and a data block; what may be among the k best."""

    def walk(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).to_pylist()[0]
        asked = Index.unpack(row["asked"])
        worst = dict(pickle.loads(row["worst"])) if row["worst"] else {}
        bound = np.array([worst.get(q, -np.inf) for q in asked.ids.tolist()], float)
        best = search(asked, Index.unpack(row["index"]), k, bound)
        there = np.isfinite(best.scores) & (best.scores >= bound[:, None])
        n = int(there.sum())
        return pa.table({"own_cell": np.full(n, row["own_cell"], np.int32),
                         "group": np.full(n, row["group"], np.int32),
                         "query_id": best.ids[np.nonzero(there)[0]], "vec_id": best.found[there],
                         "score": best.scores[there].astype(np.int64)})

    # A group is one pair, so a task holds two indexes at a time.
    return pairs.groupBy("own_cell", "group", "cell", "block").applyInArrow(walk, FOUND)


def open_cells(groups: DataFrame, reached: DataFrame, cells: list, pivots: np.ndarray,
               width: int) -> DataFrame:
    """For each query group the other cells that may hold a result; the cells are bounded."""
    spark = groups.sparkSession
    own = np.array([c.cell for c in cells], np.int32)
    shared = spark.sparkContext.broadcast((own, pivots[own], np.array([c.far for c in cells])))

    def choose(batches):
        own, centres, radii = shared.value
        norms = np.sqrt((centres ** 2).sum(axis=1))
        for batch in batches:
            q, s = _matrix(batch["q"], width), batch["s"].to_numpy()
            least = batch["least"].to_numpy(zero_copy_only=False)
            limit = (q @ centres.T + np.sqrt((q ** 2).sum(axis=1))[:, None] * radii
                     + norms * s[:, None] + radii * s[:, None])
            usable = (limit + 0.5 >= least[:, None]) & (batch["own_cell"].to_numpy()[:, None] != own)
            row, cell = np.nonzero(usable)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch[c].take(take) for c in ("own_cell", "group", "q", "s", "least", "worst")]
                + [pa.array(own[cell])],
                names=["own_cell", "group", "q", "s", "least", "worst", "cell"])

    bounded = (groups.select("own_cell", "group", "q", "s", "asked_ids")
               .join(reached, ["own_cell", "group"], "left")
               # Without a k-th score for every query of the group nothing can be ruled out.
               .withColumn("least", F.when(F.col("known") == F.col("asked_ids"), F.col("least"))
                           .otherwise(F.lit(float("-inf"))))
               .select("own_cell", "group", "q", "s", "least", "worst"))
    return bounded.mapInArrow(choose, "own_cell int, group int, q array<double>, s double, "
                                      "least double, worst binary, cell int")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``queries`` are rows of the same kind; a vector is no candidate of its own id. Vectors that are
    null or hold a null or non-finite component take no part, nor do rows without an id. Rows of
    the same id and vector count once; one id with several vectors is searched with each, and is
    one candidate for each. Components must be below 2**22, so that scores are exact. Empty
    tables give no rows. Further columns are not looked at.
    """
    spark = vectors.sparkSession
    data = durable(whole_vectors(vectors, id_column, vector_column).distinct())
    asked = durable(whole_vectors(queries, id_column, vector_column).distinct())
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    of_asked = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not facts.n or not of_asked.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(facts.width, of_asked.width, 1)
    n_cells = min(MOST_PIVOTS, max(1, round(math.sqrt(facts.n / 64))))
    chosen = data.orderBy(F.xxhash64("id", "vector")).limit(n_cells).collect()  # at most MOST_PIVOTS
    pivots = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        pivots[i, :len(row.vector)] = row.vector
    data = dealt(data, pivots, width, BLOCK_ROWS)
    trees = built(data, width, k + 1)
    cells = data.groupBy("cell").agg(F.max("far").alias("far")).collect()  # a row per pivot
    groups = built(dealt(asked, pivots, width, GROUP_ROWS), width, None).select(
        F.col("cell").alias("own_cell"), F.col("block").alias("group"), F.col("centre").alias("q"),
        F.col("radius").alias("s"), F.col("ids").alias("asked_ids"), F.col("index").alias("asked"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    near = (groups.join(trees.withColumn("own_cell", F.col("cell")), "own_cell")
            .withColumn("worst", F.lit(None).cast("binary")))
    first = durable(walked(near, k).withColumn("rank", F.row_number().over(by_query))
                    .where(F.col("rank") <= k))

    def bounds(table: pa.Table) -> pa.Table:
        worst = list(zip(table["query_id"].to_pylist(), table["score"].to_pylist(), strict=True))
        return pa.table({"own_cell": table["own_cell"][:1], "group": table["group"][:1],
                         "least": pa.array([float(min(s for _, s in worst))]),
                         "worst": pa.array([pickle.dumps(worst)], pa.binary()),
                         "known": pa.array([len(worst)], pa.int64())})

    reached = (first.where(F.col("rank") == k).groupBy("own_cell", "group")
               .applyInArrow(bounds, "own_cell int, group int, least double, worst binary, known long"))
    limit = (_dot("q", "centre") + F.sqrt(_dot("q", "q")) * F.col("radius")
             + F.sqrt(_dot("centre", "centre")) * F.col("s") + F.col("radius") * F.col("s"))
    far = (open_cells(groups, reached, cells, pivots, width)
           .join(trees.select("cell", "block", "centre", "radius"), "cell")
           .where(limit + 0.5 >= F.col("least"))
           .select("own_cell", "group", "worst", "cell", "block")
           .join(trees.select("cell", "block", "index"), ["cell", "block"])
           .join(groups.select("own_cell", "group", "asked"), ["own_cell", "group"]))
    return (first.select("query_id", "vec_id", "score")
            .unionByName(walked(far, k).select("query_id", "vec_id", "score"))
            .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
