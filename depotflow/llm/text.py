"""Whole texts as numpy arrays inside tasks: slices, words, hashes, ragged gathers.

Texts are handled as their UTF-8 bytes. Every class of word used here keeps all bytes from
0x80 up inside words, so splitting bytes splits code points rightly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one numpy step works on; arrays of eight bytes a byte stay small.
SLICE_BYTES = 1 << 22

# Word classes by byte: what is true belongs to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str,
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cut a batch so that each part holds at most ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
                     if isinstance(batch[text], pa.Array)
                     else pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """The words of some texts: ``codes`` into ``distinct``, and each text's first word."""

    codes: np.ndarray
    distinct: pa.Array
    rows: np.ndarray  # len(texts) + 1 offsets into codes

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_all(self.distinct)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def hash_all(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; they are cut out of one buffer, as most of the time goes into making objects."""
    if not len(values):
        return np.zeros(0, np.uint64)
    _, offsets, data = values.cast(pa.large_binary()).buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    raw = data[bounds[0]:bounds[-1]].to_pybytes() if data is not None else b""
    bounds = (bounds - bounds[0]).tolist()
    cuts = map(raw.__getitem__, map(slice, bounds[:-1], bounds[1:]))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, cuts), np.uint64, len(values))


def word_bounds(data: np.ndarray, offsets: np.ndarray,
                belongs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data`` and the first word of each row; none crosses rows."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = belongs[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edges] |= inside[edges]
    ends = inside[:-1] & ~inside[1:]
    ends[edges[1:] - 1] |= inside[edges[1:] - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values of the slices [start, end) of ``data``."""
    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    if int(bounds[-1]) == len(data):
        packed = data
    else:
        step = np.zeros(len(data) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        packed = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    coded = pa.Array.from_buffers(
        pa.binary(), len(starts),
        [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))],
    ).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def words(column: pa.Array | pa.ChunkedArray, belongs: np.ndarray, lower: bool = True) -> Words:
    """Split every text of a column; ``lower`` maps A-Z to a-z and nothing else."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, belongs)
    codes, distinct = encode(data, starts, ends)
    return Words(codes, distinct, rows)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one to one."""
    values = (values ^ (values >> np.uint64(32))) * MIX2
    values = (values ^ (values >> np.uint64(32))) * MIX2
    return values ^ (values >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * MIX
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * MIX + hashes[k:k + n]
    return mix(out)


def within(rows: np.ndarray, size: int, total: int) -> np.ndarray:
    """True where ``size`` words from a word on stay in its text."""
    n = max(total - size + 1, 0)
    left = np.repeat(rows[1:], np.diff(rows))[:n]
    return np.arange(n) + size <= left


def gather(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [first, first + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(firsts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
