"""Questions from blocks of documents to buckets of keys, and the answers back.

Documents are dealt by a hash into blocks of bounded text. A block gathers what it has to say about
its keys (64-bit hashes), each distinct key once and in ascending order, and sends it to
buckets of the key space as packed arrays: one row per block and bucket. A bucket sees all that any block
said of its keys and answers each block, one value a key in the same order. So a key that a
third of all rows hold reaches its bucket once a block, and a task holds one block or one bucket.

Rows of a block may come in any order; they are sorted before anything depends on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20  # text of a block, about
SAID = "bucket int, block int, level int, keys binary, values binary"
ANSWER = "block int, level int, bucket int, values binary, summary binary"
MOST_PARTITIONS = 20_000  # beyond this, a task takes several blocks in turn
KEY_BYTES = 6  # of a key besides the bits that its bucket stands for


def blocked(docs: DataFrame, text_column: str = "text",
            block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Rows packed by ``block`` (see ``unpacked``), and the number of blocks, in proportion to the text.

    The rows travel compressed, since every question to the blocks reads them again.
    """
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    key = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if kind in ("bigint", "int", "string")])
    names = docs.columns

    def pack(batches):
        for batch in batches:
            own = batch["block"].to_numpy()
            order = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(own[order], prepend=-1)).tolist() + [len(own)]
            blocks, packed = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = batch.select(names).take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema,
                                       options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(rows)
                blocks.append(int(own[order[a]])), packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["block", "rows"])

    rows = docs.withColumn("block", F.pmod(key, F.lit(n)).cast("int"))
    return dealt(rows.mapInArrow(pack, "block int, rows binary"), n, "block"), n


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of a block, in an order of their own: parts of a shuffle come in any order, and a
    block that is read again must look alike."""
    rows = pa.concat_tables([pa.ipc.open_stream(r.as_buffer()).read_all() for r in table["rows"]])
    by = [f.name for f in rows.schema if pa.types.is_integer(f.type) or pa.types.is_string(f.type)]
    return rows.sort_by([(name, "ascending") for name in by]).combine_chunks()


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, the like bytes of all numbers together, compressed."""
    if not len(values):
        return b""
    raw = np.ascontiguousarray(values).reshape(len(values), -1).view(np.uint8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, kind: np.dtype, width: int = 1) -> np.ndarray:
    """Rows of ``width`` numbers of ``kind``."""
    item = np.dtype(kind).itemsize * width
    if not data:
        return np.zeros((0, width), kind)
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(item, -1).T).view(kind).reshape(-1, width)


def dealt(rows: DataFrame, n: int, column: str) -> DataFrame:
    """Deal rows to as many partitions as there are blocks: the work on a block is worth a task,
    however small its rows are."""
    return rows.repartition(min(n, MOST_PARTITIONS), column)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def say(block: int, level: int, keys: np.ndarray, values: np.ndarray, n: int,
        key_bytes: int = KEY_BYTES) -> pa.RecordBatch:
    """Rows for all buckets, also the empty ones; ``keys`` ascend, ``values`` has a row per key.

    Keys travel as the steps between their highest bits: ``key_bytes`` and those that the bucket stands for.
    """
    edges = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    cut = np.uint64(max(0, 64 - 8 * key_bytes - (n - 1).bit_length()))
    steps = np.diff(keys >> cut, prepend=np.uint64(0))
    # The first key of a bucket is told from where the bucket begins.
    some = np.flatnonzero(edges[1:] > edges[:-1])
    begin = (((some.astype(np.uint64) << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n)) << np.uint64(32)
    steps[edges[some]] = (keys[edges[some]] >> cut) - (begin >> cut)
    edges = edges.tolist()
    parts = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, block, np.int32)),
         pa.array(np.full(n, level, np.int32)),
         pa.array([pack(steps[a:b]) for a, b in parts], pa.binary()),
         pa.array([pack(values[a:b]) for a, b in parts], pa.binary())],
        names=["bucket", "block", "level", "keys", "values"])


#: What a block with no documents says.
NOTHING = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()),
                    "level": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()),
                    "values": pa.array([], pa.binary())})

Answerer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, bytes]]


#: How to answer on a level: kind and number of the values of a key, the answerer.
How = tuple[np.dtype, int, Answerer]


def answered(said: DataFrame, n: int, how: dict[int, How]) -> DataFrame:
    """Let buckets answer. ``answer(group, values)`` gets, for all that was said on a level in a
    bucket, the number of the key (equal keys, equal number) and the values; it returns a value
    each, and a few bytes on the bucket as a whole."""

    def work(table: pa.Table) -> pa.Table:
        out = []
        # Rows come in any order, and may come in another one when a stage is run again.
        table = table.sort_by("block")
        levels = table["level"].to_numpy()
        for level, (kind, width, answer) in how.items():
            rows = table.take(pa.array(np.flatnonzero(levels == level)))
            if not rows.num_rows:
                continue
            keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"].to_pylist()]
            sizes = [len(k) for k in keys]
            values = np.concatenate([unpack(v, kind, width) for v in rows["values"].to_pylist()])
            _, group = np.unique(np.concatenate(keys), return_inverse=True)
            found, summary = answer(group, values)
            edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
            out.append(pa.table({
                "block": rows["block"], "level": rows["level"], "bucket": rows["bucket"],
                "values": pa.array([pack(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)],
                                   pa.binary()),
                "summary": pa.array([summary] * len(sizes), pa.binary())}))
        return pa.concat_tables(out)

    # Dealt by block here, answers of several questions can be put together without being dealt again.
    return dealt(dealt(said, n, "bucket").groupBy("bucket").applyInArrow(work, ANSWER), n, "block")


def rows_of(answers: pa.Table, level: int, column: str = "values") -> list[bytes]:
    """What the buckets answered to a block on one level, by bucket."""
    found = sorted((b, v) for b, lv, v in zip(
        answers["bucket"].to_pylist(), answers["level"].to_pylist(), answers[column].to_pylist(),
        strict=True) if lv == level)
    return [v for _, v in found]


def heard(answers: pa.Table, level: int, kind: np.dtype) -> np.ndarray:
    """The answers to a block of one level, in the order of its keys."""
    rows = [unpack(v, kind).ravel() for v in rows_of(answers, level)]
    return np.concatenate(rows) if rows else np.zeros(0, kind)
