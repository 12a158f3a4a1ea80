"""Near-duplicate documents by SimHash fingerprints, compared exactly in tiles.

1. A fingerprint has a bit set where more than half of the hashes of the text's word shingles have it.
   Documents with equal fingerprints are one class from here on, however many there are.
2. Population counts tell which fingerprints can be near each other at all: where they differ by more
   than the radius, so do the bits. Here they are counted for the two halves, and in each half for its
   sixteen pairs of bits. Two fingerprints that differ in at most three bits differ in at most one bit
   in one of the halves, so that there at most one of the sixteen counts differs, by one. A tile holds the
   fingerprints with the same counts of one half; it meets itself and the up to sixteen tiles one count
   below it. All other pairs of tiles are skipped.
3. Tiles that meet are compared in full by numpy: exclusive or, bit counts, radius. Large tiles are
   put in the order of the population count of the whole and cut; pieces whose counts are too far
   apart are skipped again. A tile with more than ``TILE`` fingerprints is dealt to several tasks, each with
   a part of its own fingerprints; what it meets is streamed past that part, so that memory is bounded.
4. A task gives no more links than join what it found (to the first member), then links are joined to components.

Nothing is sampled or dropped, and no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.llm.neardup import components
from depotflow.llm.text import LOWER, NOT_SPACE, gather, slices, text_bytes, word_bounds
from depotflow.session import durable

SHINGLE = 3
SEED = 42
RADIUS = 3  # the tiles below rest on this: three bits over two halves leave one half with one at most
TILE = 1 << 13  # fingerprints of a tile that one task holds
PIECE = 1 << 11  # fingerprints on a side of one numpy comparison
SMALL = 64  # groups up to this size are compared together, diagonal by diagonal

# The primes of XXH64, fixed values.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

ONES = np.uint64(0x0101010101010101)
EVEN = np.uint64(0x55555555)


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the slices [start, start + length) of ``data``, short ones all at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    fours = np.ndarray((len(data) + 5,), "<u4", padded, 0, (1,))
    out = np.uint64((seed + int(P5)) % (1 << 64)) + lengths.astype(np.uint64)
    for lane in range(3):
        has = np.flatnonzero(lengths >= 8 * (lane + 1))
        value = _turned(eights[starts[has] + 8 * lane] * P2, 31) * P1
        out[has] = _turned(out[has] ^ value, 27) * P1 + P4
    at = starts + (lengths & ~7)
    has = np.flatnonzero(lengths & 4)
    out[has] = _turned(out[has] ^ (fours[at[has]] * P1), 23) * P2 + P3
    at += lengths & 4
    for byte in range(3):
        has = np.flatnonzero((lengths & 3) > byte)
        out[has] = _turned(out[has] ^ (padded[at[has] + byte] * P5), 11) * P1
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    out ^= out >> np.uint64(32)
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(lengths >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i]:starts[i] + lengths[i]], seed)
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes; of none it is zero.

    Bits are counted eight at a time in the bytes of a word, over at most 255 hashes, then added up.
    """
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    runs = counts[filled]
    blocks = -(-runs // 255)
    firsts = np.cumsum(runs) - runs
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cuts, of_run = np.repeat(firsts, blocks) + 255 * nth, np.cumsum(blocks) - blocks
    for shift in range(8):
        tally = np.add.reduceat((hashes >> np.uint64(shift)) & ONES, cuts)
        tally = np.add.reduceat(tally.astype("<u8").view(np.uint8).reshape(-1, 8), of_run, axis=0, dtype=np.int64)
        for byte in range(8):
            out[filled] |= (2 * tally[:, byte] > runs).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprint_all(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text: A-Z lower-cased, words joined by one space, shingles with repeats."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, NOT_SPACE)
    lengths = ends - starts
    firsts = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    filled = np.ones(len(joined), bool)
    filled[firsts + lengths] = False
    joined[filled] = data[NOT_SPACE[data]]
    held = np.diff(rows)
    counts = np.where(held >= size, held - size + 1, np.minimum(held, 1))
    one = gather(rows[:-1], counts)
    last = one + np.repeat(np.minimum(held, size) - 1, counts)
    return majority(xxh64(joined, firsts[one], firsts[last] + lengths[last] - firsts[one]), counts)


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (8 bytes, the highest first) of every row; null is an empty text."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                marks = fingerprint_all(part["text"], size)
                yield pa.RecordBatch.from_arrays([part["doc_id"], _packed(marks)], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(work, f"doc_id {kind}, fingerprint binary")


def _packed(marks: np.ndarray) -> pa.Array:
    flat = pa.py_buffer(marks.astype(">u8").tobytes())
    return pa.Array.from_buffers(pa.binary(8), len(marks), [None, flat]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64)


def tiles(classes: DataFrame) -> DataFrame:
    """Each fingerprint in its tile of either half (``own``), and in those one count above it."""

    def work(batches):
        for batch in batches:
            marks = _unpacked(batch["fingerprint"])
            for half in (0, 1):
                bits = (marks >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                counts = (bits & EVEN) + ((bits >> np.uint64(1)) & EVEN)  # sixteen counts, two bits each
                place = counts | np.uint64(half << 32)
                yield _tile_rows(place, batch["fingerprint"], True)
                for pair in range(16):
                    more = np.flatnonzero((counts >> np.uint64(2 * pair)) & np.uint64(3) < 2)
                    yield _tile_rows(place[more] + np.uint64(1 << 2 * pair),
                                     batch["fingerprint"].take(pa.array(more)), False)

    return classes.select("fingerprint").mapInArrow(work, "tile long, fingerprint binary, own boolean")


def _tile_rows(place: np.ndarray, marks: pa.Array, own: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(place.astype(np.int64)), marks, pa.array(np.full(len(place), own))],
        names=["tile", "fingerprint", "own"])


def joined_by(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each member's first member so far) when the pairs (a, b) are links too."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def near_small(marks: np.ndarray, last: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius of which the first is ``own`` and the second follows it before ``last``."""
    found, step, some = [], 1, np.flatnonzero(own)
    while len(some := some[some + step < last[some]]):
        near = some[np.bitwise_count(marks[some] ^ marks[some + step]) <= RADIUS]
        found.append(np.stack([near, near + step]))
        step += 1
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def near_tiles(marks: np.ndarray, own: np.ndarray, fresh: int) -> np.ndarray:
    """Each member's first member over the links between ``own`` members and those from ``fresh`` on."""
    counts = np.bitwise_count(marks).astype(np.int64)
    left = own[np.argsort(counts[own], kind="stable")]
    right = fresh + np.argsort(counts[fresh:], kind="stable")
    root = np.arange(len(marks))
    for i in range(0, len(left), PIECE):
        some = left[i:i + PIECE]
        low = int(np.searchsorted(counts[right], counts[some[0]] - RADIUS, side="left"))
        high = int(np.searchsorted(counts[right], counts[some[-1]] + RADIUS, side="right"))
        for j in range(low, high, PIECE):
            other = right[j:min(j + PIECE, high)]
            x, y = np.nonzero(np.bitwise_count(marks[some][:, None] ^ marks[other][None, :]) <= RADIUS)
            root = joined_by(root, some[x], other[y])
    return root


def links(classes: DataFrame) -> DataFrame:
    """Pairs of fingerprints (a, b) whose components are those of all pairs within the radius."""
    rows = tiles(classes)
    large = durable(rows.where("own").groupBy("tile").count().where(F.col("count") > TILE)
                    .select("tile", F.ceil(F.col("count") / TILE).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    # Every task of a large tile sees all rows, and holds its part of the tile's own ones.
    dealt = (rows.join(large, "tile", "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
             .withColumn("own", F.col("own") & (F.pmod(F.xxhash64("fingerprint"), parts) == F.col("part")))
             .select("tile", "part", (~F.col("own")).alias("other"), "fingerprint")
             .repartition("tile", "part").sortWithinPartitions("tile", "part", "other"))

    def work(batches):
        held = None  # own rows of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            old = held.num_rows if held is not None else 0
            table = pa.Table.from_batches([held, batch] if old else [batch]).combine_chunks()
            tile, part = table["tile"].to_numpy(), table["part"].to_numpy()
            own = ~table["other"].to_numpy()
            packed = table["fingerprint"].combine_chunks()
            marks = _unpacked(packed)
            new = np.ones(len(tile), bool)
            new[1:] = (tile[1:] != tile[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(tile)))
            last = np.repeat(first + sizes, sizes)
            root = np.arange(len(tile))
            small = np.repeat(sizes <= SMALL, sizes)
            a, b = near_small(marks, np.where(small, last, 0), own & small)
            root = joined_by(root, a, b)
            for begin, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                mine = np.flatnonzero(own[begin:begin + n])
                fresh = old if not begin else 0  # what was held has been compared with itself
                if len(mine) and fresh < n:
                    group = near_tiles(marks[begin:begin + n], mine, fresh)
                    linked = np.flatnonzero(group != np.arange(n))
                    root = joined_by(root, begin + linked, begin + group[linked])
            ends = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([packed.take(pa.array(root[ends])), packed.take(pa.array(ends))],
                                             names=["a", "b"])
            going = np.flatnonzero(own[first[-1]:])
            held = table.slice(int(first[-1]), len(going)).combine_chunks().to_batches()
            held = held[0] if held else None

    return dealt.mapInArrow(work, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    least id that is reached over fingerprints at most three bits apart.

    A null text is an empty one; a text without words has the fingerprint zero and is linked like any
    other. Fewer words than a shingle's are one shingle. Rows are linked by their fingerprints only, so
    repeated rows are linked and rows that merely share an id are not. A row without an id is linked
    too; its component is the least id there, or null. Further columns are left out.
    """
    marked = durable(fingerprints(docs, size, id_column, text_column))
    classes = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes)).withColumnRenamed("node", "fingerprint")
    grouped = durable(classes.join(roots, "fingerprint", "left")
                      .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(grouped.join(least, "root").select("fingerprint", "component_id"))
    return (marked.join(named, "fingerprint")
            .select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id"))
