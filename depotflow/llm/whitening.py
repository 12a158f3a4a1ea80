"""Whitening of embeddings by the leading principal components.

1. Vectors become whole numbers; counts and sums per dimension are added up exactly over all rows.
2. The covariance is a second pass: each task centres its rows by the exact mean before it multiplies,
   and tasks' sums are added in Spark. What comes to the driver is one matrix of the dimensions.
3. There the matrix is made tridiagonal by Householder reflections, its leading eigenvalues are found by
   bisection on Sturm counts, and their vectors by inverse iteration, made orthogonal again within
   clusters of close eigenvalues and turned back by the reflections.
4. The components, as large as the dimensions times their number, are broadcast, and a last pass projects.
   A pass before it measures the covariance of what is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotflow.session import durable

SCALE = 64
SHIFT = 1_000_000
MOST = 32  # components
LARGEST = 1 << 62  # a scaled component from here on is no whole number of 64 bits, as if not finite
CLOSE = 1e-3  # eigenvalues nearer than this, as a share of the largest, form a cluster
ROUNDS = 3  # of inverse iteration
LIMB = 25  # bits of the lower part where squares are added exactly


# -- symmetric eigenvalues ------------------------------------------------------------
def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, second diagonal, and the unit vectors of the Householder reflections, by dimension."""
    a = matrix.copy()
    reflections = []
    for k in range(len(a) - 2):
        x = a[k + 1:, k]
        scale = np.abs(x).max()
        v = x / scale if scale else np.zeros_like(x)
        if scale and np.abs(v[1:]).max():
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            kept = x - 2 * (v @ x) * v
            a[k + 1:, k] = a[k, k + 1:] = np.concatenate([kept[:1], np.zeros(len(kept) - 1)])
        else:
            v = np.zeros_like(x)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value in ``at`` the number of eigenvalues below it."""
    tiny = np.finfo(float).tiny * 4
    least = max(float(np.abs(second).max(initial=0)) ** 2 * np.finfo(float).eps ** 2, tiny)
    pivot = diagonal[0] - at
    below = np.zeros(np.shape(at), int)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - at - second[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)  # an eigenvalue of a part counts as below
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, each between bounds that bisection brings to neighbouring doubles."""
    n = len(diagonal)
    reach = np.concatenate([[0], np.abs(second)]) + np.concatenate([np.abs(second), [0]])
    wanted = n - np.arange(min(most, n))  # the eigenvalue with wanted - 1 others below it
    low = np.full(len(wanted), (diagonal - reach).min())
    high = np.full(len(wanted), (diagonal + reach).max())
    slack = np.finfo(float).eps * n * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - slack, high + slack
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return high
        below = sturm_counts(diagonal, second, middle) >= wanted
        high, low = np.where(below, middle, high), np.where(below, low, middle)


def _solved(diagonal: np.ndarray, second: np.ndarray, values: np.ndarray, right: np.ndarray,
            least: float) -> np.ndarray:
    """(T - value) x = right for every value at once, by elimination with row exchanges."""
    n, many = len(diagonal), len(values)
    one, two, three = (np.zeros((n, many)) for _ in range(3))  # a row's entries from the diagonal on
    b = right.copy()
    here = (diagonal[0] - values, np.full(many, second[0] if n > 1 else 0.0), np.zeros(many))
    for i in range(n - 1):
        off = np.full(many, second[i])
        after = np.full(many, second[i + 1] if i + 2 < n else 0.0)
        below = (off, diagonal[i + 1] - values, after)
        turn = np.abs(off) > np.abs(here[0])
        top = [np.where(turn, y, x) for x, y in zip(here, below, strict=True)]
        low = [np.where(turn, x, y) for x, y in zip(here, below, strict=True)]
        b[i], b[i + 1] = np.where(turn, b[i + 1], b[i]), np.where(turn, b[i], b[i + 1])
        top[0] = np.where(np.abs(top[0]) < least, least, top[0])
        factor = low[0] / top[0]
        one[i], two[i], three[i] = top
        here = (low[1] - factor * top[1], low[2] - factor * top[2], np.zeros(many))
        b[i + 1] -= factor * b[i]
    one[n - 1] = np.where(np.abs(here[0]) < least, least, here[0])
    x = np.zeros((n + 2, many))
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - two[i] * x[i + 1] - three[i] * x[i + 2]) / one[i]
        # Only the direction counts; keep it from running out of range.
        size = np.abs(x[i])
        far = size > 1e150
        if far.any():
            shrink = np.where(far, 1 / np.maximum(size, 1), 1.0)
            x, b = x * shrink, b * shrink
    return x[:n]


def _orthogonal(vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Unit columns, each made orthogonal to those before it in its cluster, twice."""
    for j in range(vectors.shape[1]):
        for _ in range(2):
            vectors[:, j] /= np.linalg.norm(vectors[:, j])
            before = vectors[:, :j][:, cluster[:j] == cluster[j]]
            vectors[:, j] -= before @ (before.T @ vectors[:, j])
        vectors[:, j] /= np.linalg.norm(vectors[:, j])
    return vectors


def leading_eigenvectors(matrix: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    n = len(matrix)
    if not matrix.any():
        return np.zeros(min(n, most)), np.eye(n, min(n, most))
    diagonal, second, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, second, most)
    norm = max(float(np.abs(diagonal).max()) + 2 * float(np.abs(second).max(initial=0)), np.finfo(float).tiny)
    cluster = np.concatenate([[0], np.cumsum(values[:-1] - values[1:] > CLOSE * norm)])
    # Equal eigenvalues get slightly different shifts, and every vector a start of its own.
    shifts = values - np.finfo(float).eps * norm * np.arange(len(values))
    vectors = np.random.default_rng(0).uniform(0.5, 1.5, (n, len(values)))
    vectors *= np.random.default_rng(1).choice([-1.0, 1.0], vectors.shape)
    for _ in range(ROUNDS):
        vectors = _solved(diagonal, second, shifts, vectors, np.finfo(float).eps * norm)
        vectors = _orthogonal(vectors / np.abs(vectors).max(axis=0), cluster)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values, _orthogonal(vectors, cluster)


# -- vectors as whole numbers ---------------------------------------------------------
def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the vectors that take part: their rows, their lengths, and their whole numbers, flat.

    A vector takes part if neither it nor a component of it is null, and all are finite.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    scaled = np.floor(SCALE * flat.cast(pa.float64()).to_numpy(zero_copy_only=False))  # null becomes nan
    bad = ~(np.abs(scaled) < LARGEST)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[owner[bad]] = False
    return np.flatnonzero(good), lengths[good], scaled[good[owner]].astype(np.int64) + SHIFT


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and whole numbers, one line a vector, of the vectors of ``size`` dimensions that take part."""
    rows, lengths, flat = whole(column)
    fits = lengths == size
    return rows[fits], flat[np.repeat(fits, lengths)].reshape(int(fits.sum()), size)


@dataclass
class Whitening:
    """What is learnt of all vectors."""

    n: int
    sums: list[int]  # exact sum of each dimension's whole numbers
    values: np.ndarray  # eigenvalues of the components that are kept, falling
    vectors: np.ndarray  # their unit vectors, as columns
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []

    def centred(self, numbers: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are subtracted as such, so no digit of a large x is lost."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (numbers - near).astype(float) - rest

    def deviations(self, numbers: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]  # n x - S = n (x - near) - rest
        away = numbers - near
        if self.n * (float(np.abs(away).max(initial=0)) + 1) < 1 << 2 * LIMB:
            y = self.n * away - np.array(rest, np.int64)
            high, low = y >> LIMB, y & ((1 << LIMB) - 1)
            parts = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
            return [(a << 2 * LIMB) + (b << LIMB + 1) + c
                    for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
        return [sum((self.n * x - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in away.tolist()]

    def projected(self, numbers: np.ndarray) -> np.ndarray:
        return self.centred(numbers) @ (self.vectors / np.sqrt(self.values))


def _covariance(vectors: DataFrame, model: Whitening, size: int, project: bool) -> np.ndarray:
    """Covariance, divisor n, of the centred or of the projected vectors.

    Each task centres by the mean, adds up products, and gives the lower triangle as rows; Spark adds these.
    The projected vectors are centred by their own mean too, by the sums that come along.
    """
    width = len(model.values) if project else size
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model, total, sums = shared.value, np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            _, numbers = _matrix(batch["vector"], size)
            rows = model.projected(numbers) if project else model.centred(numbers)
            total += rows.T @ rows
            sums += rows.sum(axis=0)
        i, j = np.tril_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.full(width, -1)]).astype(np.int32)),
             pa.array(np.concatenate([j, np.arange(width)]).astype(np.int32)),
             pa.array(np.concatenate([total[i, j], sums]))], names=["i", "j", "value"])

    parts = (vectors.select("vector").mapInArrow(work, "i int, j int, value double")
             .groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas())
    i, j, value = (parts[c].to_numpy() for c in ("i", "j", "value"))
    out, mean = np.zeros((width, width)), np.zeros(width)
    inner = i >= 0
    out[i[inner], j[inner]] = out[j[inner], i[inner]] = value[inner] / model.n
    mean[j[~inner]] = value[~inner] / model.n
    return out - np.outer(mean, mean)


def _named(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"))


def fit(vectors: DataFrame, vector_column: str = "embedding", most: int = MOST) -> Whitening:
    """Learn the components from all vectors that take part.

    Vectors of another length than the commonest (of equal ones the longest) take no part.
    Components without variance, which cannot be whitened, are left out.
    """
    rows = vectors.select(F.col(vector_column).alias("vector"))

    def work(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            _, lengths, flat = whole(batch["vector"])
            for size in np.unique(lengths).tolist():
                numbers = flat[np.repeat(lengths == size, lengths)].reshape(int((lengths == size).sum()), size)
                own = sums.setdefault(size, [0, [0] * size])
                own[0] += int((lengths == size).sum())
                high, low = (numbers >> 32).sum(axis=0).tolist(), (numbers & 0xFFFFFFFF).sum(axis=0).tolist()
                own[1] = [s + (h << 32) + w for s, h, w in zip(own[1], high, low, strict=True)]
        for size, (n, own) in sums.items():
            count = [n] * max(size, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(count), pa.int32()), pa.array(range(len(count)), pa.int32()),
                 pa.array(count, pa.int64()), pa.array([str(s) for s in own] or ["0"])],
                names=["size", "dim", "n", "total"])

    sums = durable(rows.mapInArrow(work, "size int, dim int, n long, total string").groupBy("size", "dim")
                   .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    commonest = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if commonest is None or not commonest["size"]:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    size = commonest["size"]
    exact = [int(r["total"]) for r in sums.where(F.col("size") == size).orderBy("dim").collect()]
    model = Whitening(commonest["n"], exact, np.zeros(0), np.zeros((size, 0)), 0.0)
    covariance = _covariance(rows, model, size, False)
    values, components = leading_eigenvectors(covariance, most)
    model.trace = float(np.trace(covariance))
    kept = values > model.trace * size * np.finfo(float).eps
    model.values, model.vectors = values[kept], components[:, kept]
    return model


def identity_error(vectors: DataFrame, model: Whitening, vector_column: str = "embedding") -> float:
    """Largest absolute entry of the covariance of all whitened vectors less the identity, measured."""
    if not len(model.values):
        return 0.0
    measured = _covariance(vectors.select(F.col(vector_column).alias("vector")), model, len(model.sums), True)
    return float(np.abs(measured - np.eye(len(measured))).max())


def whitened(vectors: DataFrame, model: Whitening, id_column: str = "vec_id",
             vector_column: str = "embedding") -> DataFrame:
    """``vec_id``, ``deviation`` (decimal, exact; null beyond 38 digits) and ``whitened``, an array with a
    value for each component, of every vector that takes part.

    Null ids, repeated ids and repeated vectors stay as they are; further columns are left out. Without
    vectors there are no rows.
    """
    rows = _named(vectors, id_column, vector_column)
    kind, size = rows.schema["vec_id"].dataType.simpleString(), len(model.sums)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    limit = 10 ** 38

    def work(batches):
        model = shared.value
        for batch in batches:
            if not model.n:
                continue
            which, numbers = _matrix(batch["vector"], size)
            values = model.projected(numbers)
            bounds = pa.array(np.arange(len(which) + 1, dtype=np.int32) * values.shape[1], pa.int32())
            exact = [d if d < limit else None for d in model.deviations(numbers)]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(which)), pa.array(exact, pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(values).ravel()))],
                names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(work, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def by_component(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """One row per row of ``whitened`` and component, with what holds for the component."""
    explained: Column = F.array(*[F.lit(float(x)) for x in model.explained] or [F.lit(0.0)])
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
            .select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    F.col("deviation").try_cast("long").alias("deviation"), "whitened",
                    F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error")))
